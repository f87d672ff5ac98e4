"""Packing of documents into token sequences of one length by best-fit decreasing.

A document's ids and the end id are first cut into full windows of ``size`` ids, each a sequence of its own. The rests go,
longest first, into the tightest window that still takes them; a segment tree indexed by remaining capacity finds it. What
best fit leaves too empty is topped up: pieces of the emptiest windows are cut to fill the fullest, so that only one window
of a batch is left, which is laid out as sequences whose lengths are powers of two and so need no padding.

Scale: one pass without any shuffle. Each partition of the input packs its own documents, in batches of ``batch_ids`` ids
of rests, so a task holds one Arrow batch and one such batch of rests, however many documents it reads.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import runs
from .common import ship
from .token_files import MARKS, byte_letters

#: Entries that a worker's cache of words holds before it starts afresh.
CACHE = 1_000_000
#: Sequences of one partition have numbers below this, above the partition's own.
SHIFT = 33

#: Settings of a tokenizers file under which a space before a word always begins a piece: fixed values.
BY_SPACES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None}

_BREAK, _ODD = re.compile(r"(?= \S)"), re.compile(r" (?!\S)")
_MARKS = MARKS.decode()
_coders: dict[str, SpacedCoder] = {}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of words behind ``front`` (a space or nothing), as bytes; each distinct word is encoded once."""

    def __init__(self, coder: SpacedCoder, front: str):
        super().__init__()
        self.coder, self.front = coder, front
        self.letter = "Ġ" if front else ""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < "\u0180"):  # one run of letters is one piece
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.coder.letters)
            out = _packed([t.id for t in self.coder.model.tokenize(self.letter + letters)])
        elif len(stem := word.rstrip(_MARKS)) < len(word) and stem.isascii() and stem[-1:].isalpha():
            out = self[stem] + self.coder.bare[word[len(stem) :]]
        elif "\n" in word and (parts := word.split("\n")) == word.split():
            # A line feed between two other characters is a piece, and what follows begins one.
            bare = self.coder.bare
            out = self[parts[0]] + b"".join([bare["\n"] + bare[p] for p in parts[1:]])
        else:
            out = self.coder.whole(self.front + word)
        self[word] = out
        return out


class SpacedCoder:
    """Ids of texts by a tokenizers file. If its settings are ``BY_SPACES``, words between spaces are encoded once each."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.special = [t["content"] for t in settings["added_tokens"]]
        model = settings["model"]
        self.by_spaces = model["type"] == "BPE" and not model.get("dropout") and all(settings.get(k) == v for k, v in BY_SPACES.items())
        self.letters = dict(enumerate(byte_letters()))
        self.bare, self.spaced = _Words(self, ""), _Words(self, " ")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _packed(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_spaces or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.bare) + len(self.spaced) > CACHE:
            self.bare.clear()
            self.spaced.clear()
        if _ODD.search(text):  # some space is followed by white space or nothing: it stays with what is before it
            first, *rest = _BREAK.split(text)
            if first[:1] == " ":
                return self.whole(first) + b"".join(map(self.spaced.__getitem__, [w[1:] for w in rest]))
            return self.bare[first] + b"".join(map(self.spaced.__getitem__, [w[1:] for w in rest]))
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def spaced_coder(path: str) -> SpacedCoder:
    """This worker's coder; kept between tasks."""
    if path not in _coders:
        _coders[path] = SpacedCoder(path)
    return _coders[path]


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over the capacities finds the tightest that takes a piece."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.held = [0] * (2 * self.leaves)  # windows below each node
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node, held = self.leaves + capacity, self.held
        while node:
            held[node] += change
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._count(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window of the smallest capacity of ``length`` at least: (capacity, window), or None."""
        node, held = self.leaves + length, self.held
        if not held[node]:
            while node > 1 and (node & 1 or not held[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not held[2 * node])
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()


Piece = tuple[int, int, int]


def _binary(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces cut into windows whose lengths are powers of two, longest first."""
    left, queue = sum(n for _, _, n in pieces), pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            item, start, n = queue.pop()
            if n > room:
                queue.append((item, start + room, n - room))
                n = room
            window.append((item, start, n))
            room -= n
        yield window


def pack(lengths: list[int], size: int, slack: int | None = None) -> list[list[Piece]]:
    """Windows of (item, start in it, length) that hold items of these lengths (1 to ``size``), each id once.

    Best-fit decreasing; then windows with more than ``slack`` ids of room (``size // 128`` if None) are topped up. Items
    of equal length go in their order.
    """
    slack = size // 128 if slack is None else slack
    windows: list[list[Piece]] = []
    rooms: list[int] = []
    tree = OpenWindows(size)
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[item]
        found = tree.tightest(n)
        if found is None:
            found = size, len(windows)
            windows.append([])
            rooms.append(size)
        capacity, window = found
        windows[window].append((item, 0, n))
        rooms[window] = capacity - n
        if capacity > n:
            tree.put(capacity - n, window)
    loose = sorted((w for w, room in enumerate(rooms) if room > slack and size - room & size - room - 1), key=lambda w: (rooms[w], w))
    front, back = 0, len(loose) - 1
    while front < back:
        room, donor = rooms[loose[front]], windows[loose[back]]
        while room and donor:
            item, start, n = donor.pop()
            if n > room:
                donor.append((item, start + room, n - room))
                n = room
            windows[loose[front]].append((item, start, n))
            room -= n
        rooms[loose[front]] = room
        front += room == 0
        back -= not donor
    if front == back:
        rest, windows[loose[front]] = windows[loose[front]], []
        windows += _binary(rest)
    return [w for w in windows if w]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024, batch_ids: int = 4_000_000) -> DataFrame:
    """Pieces of the documents and where they stand: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``docs`` has doc_id (an integer) and text; other columns are ignored. ``tokenizer`` is a tokenizers file, ``ids`` are
    little-endian unsigned 32-bit integers, ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's. No sequence is longer than ``size``. A null text counts as empty: its only id is ``end_id``. Repeated rows are
    packed each for itself, null doc_ids stay null, an empty table gives an empty result. The same input splits give the
    same sequences. Sequence ids rise with partition and place there, with gaps between partitions.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    end, step = struct.pack("<I", end_id), 4 * size
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = spaced_coder(tokenizer), TaskContext.get().partitionId() << SHIFT
        rests: list[tuple[int | None, int, bytes, int]] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, rests, held
            rows = []
            for window in pack([len(x[2]) // 4 for x in rests], size):
                offset = 0
                for item, start, n in window:
                    doc, base, ids, total = rests[item]
                    rows.append((doc, base + start, n, ids[4 * start : 4 * (start + n)], total, number, offset))
                    offset += n
                number += 1
                if len(rows) >= 2000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
            rests, held = [], 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            texts = batch.column(1)
            for a, b in runs(texts.to_pylist()):
                rows = []
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()):
                    ids = coder.encode(text) + end
                    total, last = len(ids) // 4, len(ids) // step * step
                    for at in range(0, last, step):
                        rows.append((doc, at // 4, size, ids[at : at + step], total, number, 0))
                        number += 1
                    if last < len(ids):
                        rests.append((doc, last // 4, ids[last:], total))
                        held += len(ids) - last
                for k in range(0, len(rows), 2000):
                    yield table(rows[k : k + 2000])
                if held >= 4 * batch_ids:
                    yield from packed()
        yield from packed()

    kinds = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.mapInArrow(work, kinds)
