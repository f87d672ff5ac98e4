"""Byte-level BPE by DuckDB recursive queries, and decoding by ordered aggregation.

Each Spark task runs its own in-memory DuckDB over batches of its partition. Distinct pieces of text that the worker
has not met become token-position rows; a recursive query joins neighbouring tokens with the merge table and contracts
each word's leftmost minimum-rank pair until none is left. Ids of a text are looked up piece by piece. Decoding joins
token-position rows with the vocabulary and concatenates the bytes of a text in order of position.

Scale: no shuffle at all; a task's memory is bounded by the batch and two bounded caches, and at its end DuckDB's is
given back. Ranks are read on each executor from a file path.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

if TYPE_CHECKING:
    import duckdb

# A row is a token: its word, place, the next token's place and id, and rank and place of the pair they make (as one
# number, so that the least is the leftmost of the least rank). Only a contracted token and the one before it look
# their pairs up again.
_ENCODE = """
WITH RECURSIVE state(w, p, q, t, u, pair, done) AS (
    SELECT s.w, s.p, s.q, s.t, s.u, (m.rank::BIGINT << 24) | s.p, false
    FROM (
        SELECT w, p, t, lead(t) OVER places AS u, lead(p) OVER places AS q
        FROM pieces WINDOW places AS (PARTITION BY w ORDER BY p)
    ) s LEFT JOIN merges m ON m.pair = s.t::BIGINT * 4294967296 + s.u
    UNION ALL (
        WITH best AS (
            SELECT w, min(pair) & 16777215 AS p, (min(pair) >> 24)::INTEGER AS t, arg_min(q, pair) AS gone, min(pair) IS NULL AS done
            FROM state WHERE NOT done GROUP BY w
        ), gone AS (
            SELECT state.w, state.q, state.u FROM state JOIN best ON state.w = best.w AND state.p = best.gone WHERE NOT state.done
        ), contracted AS (
            SELECT s.w, s.p, CASE WHEN s.p = b.p THEN g.q ELSE s.q END AS q, CASE WHEN s.p = b.p THEN b.t ELSE s.t END AS t,
                CASE WHEN s.p = b.p THEN g.u WHEN s.q = b.p THEN b.t ELSE s.u END AS u, s.pair,
                coalesce(s.p = b.p OR s.q = b.p, false) AS changed, b.done
            FROM state s JOIN best b ON s.w = b.w LEFT JOIN gone g ON s.w = g.w
            WHERE NOT s.done AND (b.gone IS NULL OR s.p <> b.gone)
        )
        SELECT c.w, c.p, c.q, c.t, c.u, CASE WHEN changed THEN (m.rank::BIGINT << 24) | c.p ELSE c.pair END, c.done
        FROM contracted c LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN c.t::BIGINT * 4294967296 + c.u END
    )
)
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE done GROUP BY w ORDER BY w
"""

# The same contraction for long pieces. Rows are replaced by key, so that the state stays as long as the pieces, and a
# round contracts every place of a word's least rank, from the left and without overlaps: where each token of the
# vocabulary encodes to itself, no pair of a lower rank can arise from such a step, so the order is that of single steps.
_ENCODE_LONG = """
WITH RECURSIVE state(w, p, q, t, pair) USING KEY (w, p) AS (
    SELECT s.w, s.p, s.q, s.t, m.rank
    FROM (
        SELECT w, p, t, lead(t) OVER places AS u, lead(p) OVER places AS q
        FROM pieces WINDOW places AS (PARTITION BY w ORDER BY p)
    ) s LEFT JOIN merges m ON m.pair = s.t::BIGINT * 4294967296 + s.u
    UNION (
        WITH alive AS (
            SELECT * FROM recurring.state WHERE t IS NOT NULL
        ), least AS (
            SELECT w, min(pair) AS rank FROM alive GROUP BY w HAVING min(pair) IS NOT NULL
        ), hit AS (
            SELECT a.w, a.p, a.q, coalesce(lag(a.q) OVER (PARTITION BY a.w ORDER BY a.p) = a.p, false) AS follows
            FROM alive a JOIN least ON a.w = least.w AND a.pair = least.rank
        ), run AS (
            SELECT w, p, q, count(*) FILTER (NOT follows) OVER (PARTITION BY w ORDER BY p) AS run FROM hit
        ), chosen AS (
            SELECT w, p, q FROM (SELECT w, p, q, row_number() OVER (PARTITION BY w, run ORDER BY p) AS k FROM run) WHERE k % 2 = 1
        ), contracted AS (
            SELECT a.w, a.p, CASE WHEN c.p IS NULL THEN a.q ELSE gone.q END AS q, CASE WHEN c.p IS NULL THEN a.t ELSE least.rank END AS t
            FROM alive a JOIN least ON a.w = least.w LEFT JOIN chosen c ON c.w = a.w AND c.p = a.p
            LEFT JOIN alive gone ON gone.w = c.w AND gone.p = c.q ANTI JOIN chosen x ON x.w = a.w AND x.q = a.p
        ), paired AS (
            SELECT w, p, q, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS u FROM contracted
        )
        SELECT s.w, s.p, s.q, s.t, m.rank FROM paired s LEFT JOIN merges m ON m.pair = s.t::BIGINT * 4294967296 + s.u
        UNION ALL SELECT w, q, NULL, NULL, NULL FROM chosen
    )
)
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE t IS NOT NULL GROUP BY w ORDER BY w
"""

_DECODE = """
SELECT d, string_agg(v.text, '' ORDER BY p) AS text FROM tokens JOIN vocabulary v ON v.id = tokens.t GROUP BY d
"""

#: The pattern whose matches reach over a space only inside a run of white space: a fixed value.
BY_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of more bytes go to the keyed recursion, of yet more to a heap: a round there costs the length of the piece,
#: so that 16,000 bytes of random letters take 9 seconds (the heap: 0.05).
LONG_PIECE, HEAP_PIECE = 1000, 16_384
#: The first recursion keeps a row for each token of each round: the sum of squared lengths of the pieces of one query.
ROUND_ROWS = 6_000_000
#: Tokens of one decoding query.
DECODE_TOKENS = 1_500_000
#: Entries of one generation of a worker's caches of pieces and of space-delimited chunks. A cache holds two generations
#: (a few hundred bytes an entry) and what one batch adds; workers stay alive between tasks and stages, beside the JVM.
CACHE = 400_000

_coders: dict[tuple[str, str], Coder] = {}


class Cache(dict[str, bytes]):
    """Ids of strings, as a dictionary of those in use and the generation before it: what is in use again moves over."""

    def __init__(self) -> None:
        super().__init__()
        self.before: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Which of ``wanted`` are in neither generation; the others are in this one from now on."""
        if len(self) > CACHE:
            self.before = self.copy()
            self.clear()
        rest = wanted - self.keys()
        old = rest & self.before.keys()
        self.update((x, self.before[x]) for x in old)
        return rest - old


class Coder:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # \s of the library is Unicode white space, without the separators that Python's own class adds.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?=\p{White_Space}|\Z)").replace(r"\s", r"\p{White_Space}")).findall
        self.by_spaces = pattern == BY_SPACES
        self.odd = regex.compile(r"\p{White_Space} (?:\p{White_Space}|\Z)").search
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    ranks.append(rank)
        # Bytes stand as characters U+0000 to U+00FF, so that strings can hold any of them.
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "text": [t.decode("latin-1") for t in self.ranks]})
        self.tables = {"merges": pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(ranks, pa.int32())}), "vocabulary": vocabulary}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces, self.chunks = Cache(), Cache()

    @cached_property
    def db(self) -> duckdb.DuckDBPyConnection:
        """DuckDB with the merge table and the vocabulary; opened when first asked for, and again after ``rest``."""
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for name, table in self.tables.items():
            db.register("given", table)
            db.execute(f"CREATE TABLE {name} AS FROM given")
            db.unregister("given")
        return db

    def rest(self) -> None:
        """Between tasks, give back what only a running task needs: DuckDB's memory and Arrow's free pages.

        A worker outlives its stage (by a minute), beside stages that need the executor's memory for the JVM.
        """
        if "db" in self.__dict__:
            self.db.close()
            del self.db
        pa.default_memory_pool().release_unused()

    def merge_all(self, new: list[str]) -> None:
        """Put the ids of each new piece into the cache, as little-endian unsigned 32-bit integers."""
        short, long = [], []
        for s in new:
            b = s.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(b)) is not None:
                self.pieces[s] = whole.to_bytes(4, "little")
            elif len(b) > HEAP_PIECE:
                self.pieces[s] = np.array(self._heap_merge(b), "<u4").tobytes()
            else:
                (long if len(b) > LONG_PIECE else short).append((s, b))
        for part in _portions(short, [len(b) ** 2 for _, b in short], ROUND_ROWS):
            self._contract(part, _ENCODE)
        for part in _portions(long, [len(b) for _, b in long], HEAP_PIECE):
            self._contract(part, _ENCODE_LONG)

    def _contract(self, part: list[tuple[str, bytes]], query: str) -> None:
        """Put the ids of some pieces into the cache by one recursive query."""
        sizes = np.fromiter((len(b) for _, b in part), np.int64, len(part))
        flat = np.frombuffer(b"".join(b for _, b in part), np.uint8)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("pieces", pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "p": place.astype(np.int32), "t": self.of_byte[flat]}))
        ids = self.db.sql(query).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("pieces")
        ends = ids.offsets.to_numpy() * 4
        data = ids.values.to_numpy().astype("<u4").tobytes()
        for (s, _), a, b in zip(part, ends[:-1].tolist(), ends[1:].tolist()):
            self.pieces[s] = data[a:b]

    def _heap_merge(self, b: bytes) -> list[int]:
        """The same contraction for one very long piece: a heap of pairs over a linked list of tokens."""
        import heapq

        tokens: list[bytes | None] = [b[i : i + 1] for i in range(len(b))]
        after, before = list(range(1, len(b) + 1)), list(range(-1, len(b) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(b) and (r := self.ranks.get(tokens[i] + tokens[after[i]])) is not None:
                heapq.heappush(heap, (r, i, len(tokens[i]), len(tokens[after[i]])))

        for i in range(len(b)):
            offer(i)
        while heap:
            _, i, n, m = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or len(tokens[i]) != n or j >= len(b) or len(tokens[j]) != m:
                continue
            tokens[i] += tokens[j]
            tokens[j] = None
            after[i] = after[j]
            if after[i] < len(b):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[t] for t in tokens if t is not None]

    def _cut(self, text: str) -> list[str]:
        """The text at its spaces, each space with what follows; at every match where a match may reach over such a place.

        By ``BY_SPACES`` that is only so where a space stands inside a run of white space; by other patterns it may be so anywhere.
        """
        if not self.by_spaces or self.odd(text):
            return self.split(text)
        if "\0" not in text:
            return text.replace(" ", "\0 ").removeprefix("\0").split("\0")
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cuts = [self._cut(t) for t in texts]
        unseen = self.chunks.missing(set().union(*cuts))
        if unseen:
            split = {c: [c] if self.by_spaces and c[1:].isalpha() and c.isascii() and (c[0] == " " or c[0].isalpha()) else self.split(c) for c in unseen}
            self.merge_all(list(self.pieces.missing(set().union(*split.values()))))
            get = self.pieces.__getitem__
            self.chunks.update((c, b"".join(map(get, s))) for c, s in split.items())
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) for c in cuts]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        out: list[list[str]] = [[] for _ in ids]
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        for k in range(0, len(flat), DECODE_TOKENS):  # a longer text is put together from its parts
            t = flat[k : k + DECODE_TOKENS]
            self.db.register("tokens", pa.table({"d": row[k : k + DECODE_TOKENS], "p": np.arange(len(t), dtype=np.int32), "t": t}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for d, text in zip(got["d"].to_pylist(), got["text"].to_pylist()):
                out[d].append(text)
        return ["".join(parts).encode("latin-1") for parts in out]


def _portions(items: list, work: list[int], most: int) -> Iterator[list]:
    """Consecutive items of about ``most`` work together."""
    held, part = 0, []
    for x, w in zip(items, work):
        if part and held + w > most:
            yield part
            held, part = 0, []
        part.append(x)
        held += w
    if part:
        yield part


def coder(rank_file: str, pattern: str) -> Coder:
    """This worker's coder; kept between tasks."""
    if (rank_file, pattern) not in _coders:
        _coders[rank_file, pattern] = Coder(rank_file, pattern)
    return _coders[rank_file, pattern]


def runs(texts: list[str], most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most ``most`` characters, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``carry`` (doc_id), n_tokens, and ids (little-endian unsigned 32-bit) with decoded (bytes), or with
    ``digest`` their SHA-256 as ids_sha256 and decoded_sha256. A null text counts as empty and has no ids. Repeated
    rows give repeated results; an empty table gives an empty one; columns besides ``carry`` and text are ignored.
    """
    ship(docs.sparkSession)
    carry = carry or ["doc_id"]
    inner = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], F.coalesce(F.col("text"), F.lit("")).alias("t"))
    ends = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    kind = "string" if digest else "binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(rank_file, pattern)
        try:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                for a, b in runs(texts.to_pylist()):
                    part = texts.slice(a, b - a).to_pylist()
                    ids = c.encode(part)
                    back = c.decode(ids)
                    n = pa.array([len(x) // 4 for x in ids], pa.int64())
                    if digest:
                        two = [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (ids, back)]
                    else:
                        two = [pa.array(y, pa.binary()) for y in (ids, back)]
                    front = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*front, n, *two], names=[*batch.schema.names[:-1], *ends])
        finally:
            c.rest()

    out = inner.mapInArrow(work, f"{kinds}, n_tokens bigint, `{ends[1]}` {kind}, `{ends[2]}` {kind}")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], *ends)
