"""Language identification, word first with backoff to character n-grams.

A known word adds its log frequency in each language. An unseen word falls back to its character n-grams (with word
boundaries): of the longest length of which any is known, the mean log frequencies of the known ones, then shorter.
A long chunk, as in scripts without spaces, counts as several words: pieces that overlap by three characters.

Training counts the words and n-grams of about ``sample`` labelled documents, or 30 of each language if that is more,
combined before the shuffle. Each language has an equal part of the sample (chosen by a 64-bit hash of the doc_id); what
a small language cannot fill goes to the others, so that a hot language pushes out no item of a small one. All languages
and all items of the sample are kept, each item with the languages that have it: the model is bounded by the sample. Prediction is one
pass over the texts without a shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, threshold

LENGTHS = (4, 3, 2, 1)
EDGES = ".,;:!?\"'()[]{}<>|*%&$#@+=-_/\\~`^…«»“”„’‘"
#: Length of a piece of a long word; words are shorter.
PIECE = 64
#: Documents of a language that are sampled at least, so that none comes out empty.
LEAST = 30
#: Languages whose thresholds are broadcast, a row each.
SENT = 100_000
#: Cells of a worker's matrix of log frequencies, at most; rows beyond are made when a word asks for them.
CELLS = 32_000_000
#: Entries that a worker's cache of words holds before it starts afresh.
CACHE = 500_000


def clean(chunk: str) -> str:
    """A chunk between white space, lower-cased, without marks around it; empty if it has no letter."""
    word = chunk.lower().strip(EDGES)
    return word if word.isalpha() or any(map(str.isalpha, word)) else ""


def pieces(word: str) -> list[str]:
    """A cleaned word; a long one with its boundaries in pieces, of which only the last is longer than ``PIECE``."""
    if len(word) < PIECE:
        return [word] if word else []
    padded, step = f"\x02{word}\x03", PIECE - 3
    starts = range(0, len(padded) - PIECE - step, step)
    found = [*(padded[i : i + PIECE] for i in starts), padded[len(starts) * step :]]
    return [p for p in found if any(map(str.isalpha, p))]


def grams(piece: str, n: int) -> list[str]:
    """The n-grams that start in a piece: in its last three characters only if no other piece has them."""
    padded = piece if len(piece) >= PIECE else f"\x02{piece}\x03"
    found = [padded[i : i + n] for i in range(PIECE - 3 if len(piece) == PIECE else len(padded) - n + 1)]
    return found if n > 1 else [g for g in found if g not in "\x02\x03"]


def shares(counts: dict[str, int], sample: int, least: int = LEAST) -> dict[str, float]:
    """The share of each language's documents that are sampled: equal numbers, as far as there are so many.

    Where ``sample`` gives each of many languages fewer than ``least`` documents, each has that many all the same.
    """
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, max(least, left / (len(counts) - k)))
        out[lang], left = take / n, left - take
    return out


def train(docs: DataFrame, sample: int = 8_000) -> dict:
    """Model from the rows of ``docs`` (text, lang, mark) whose text and lang are not null; mark is a 64-bit hash.

    Every language is learned. One of whose documents none is sampled is an error: marks are not evenly spread then.
    """
    ship(docs.sparkSession)
    rows = docs.select("text", "lang", "mark").filter("text is not null and lang is not null")
    share = shares({r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}, sample)  # a row for each language
    if not share:
        return {"id": uuid.uuid4().hex, "langs": [], "words": {}, "grams": {}, "starts": np.zeros(1, np.int64), "at": np.zeros(0, np.int64), "gain": np.zeros(0, np.float32), "kind": np.zeros(0, np.int8), "base": np.zeros((len(LENGTHS) + 1, 0), np.float32)}
    parts = docs.sparkSession.createDataFrame([(lang, threshold(part), part >= 1) for lang, part in share.items()], "of string, below bigint, every boolean")
    if len(share) <= SENT:  # texts stay where they are; beyond that they are joined by language
        parts = F.broadcast(parts)
    rows = rows.join(parts, (F.col("lang") == F.col("of")) & (F.col("every") | (F.col("mark") < F.col("below")))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            """Words so far, and the n-grams of each distinct one as often as it stands."""
            tally: Counter = Counter()
            for (word, lang), c in held.items():
                tally[0, word, lang] += c
                for n in LENGTHS if word else ():
                    for g in grams(word, n):
                        tally[n, g, lang] += c
            keys = list(tally)
            columns = [pa.array([k[i] for k in keys], pa.string() if i else pa.int32()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([tally[k] for k in keys], pa.int64())], names=["kind", "item", "lang", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held["", lang] += 1  # the document itself: no word is empty
                for w, c in Counter(text.split()).items():
                    for word in pieces(clean(w)):
                        held[word, lang] += c
                if len(held) > 100_000:
                    yield out()
                    held.clear()
        yield out()

    counts = rows.select("text", "lang").mapInArrow(count, "kind int, item string, lang string, n bigint")
    table = counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")).toArrow()  # items of the sample
    langs = sorted(share)
    met = pc.equal(table["item"], "")
    if none := sorted({*langs} - {*table.filter(met)["lang"].to_pylist()}):
        raise ValueError(f"no document of these languages is in the sample: {none[:10]}")
    table = table.filter(pc.invert(met)).combine_chunks()
    kinds, seen = table["kind"].to_numpy(), table["n"].to_numpy()
    lang = pc.index_in(table["lang"], pa.array(langs)).to_numpy()
    model: dict = {"id": uuid.uuid4().hex, "langs": langs, "words": {}, "grams": {}}
    # Of each item only the languages that have it are held; in others its frequency is that of its kind's unseen items.
    starts, at, gain, kind_of, base = [np.zeros(1, np.int64)], [], [], [], []
    for k, kind in enumerate((0, *LENGTHS)):
        mine = np.flatnonzero(kinds == kind)
        items = table["item"].take(pa.array(mine)).combine_chunks().dictionary_encode()
        codes = items.indices.to_numpy()
        order = np.lexsort((lang[mine], codes))
        first = sum(map(len, kind_of))
        model["grams" if kind else "words"].update(zip(items.dictionary.to_pylist(), range(first, first + len(items.dictionary))))
        starts.append(starts[-1][-1] + np.cumsum(np.bincount(codes, minlength=len(items.dictionary))))
        at.append(lang[mine][order].astype(np.int64))
        gain.append(np.log(2.0 * seen[mine][order] + 1).astype(np.float32))
        kind_of.append(np.full(len(items.dictionary), k, np.int8))
        totals = np.bincount(lang[mine], weights=seen[mine], minlength=len(langs))
        base.append(np.log(0.5 / (totals + 0.5 * (len(items.dictionary) + 1))).astype(np.float32))
    return model | {"starts": np.concatenate(starts), "at": np.concatenate(at), "gain": np.concatenate(gain), "kind": np.concatenate(kind_of), "base": np.array(base)}


class Scorer(dict):
    """Chunk, or piece of a long one, to row of a matrix of log frequencies; its last column counts words with a letter.

    The matrix begins with the model's items, so that a known word needs no row of its own, and a row of zeros for
    chunks without a letter; rows of other chunks follow.
    """

    def __init__(self, model: dict):
        super().__init__()
        langs, items = len(model["langs"]), len(model["kind"])
        self.model = model
        self.base = items if items * (langs + 1) <= CELLS else 0  # items that have rows from the beginning
        self.most = min(CACHE, CELLS // (langs + 1))
        self.rows = np.zeros((self.base + 4096, langs + 1), np.float32)
        if self.base:
            self.rows[:items, :-1] = model["base"][model["kind"]]
            self.rows[np.repeat(np.arange(items), np.diff(model["starts"])), model["at"]] += model["gain"]
            self.rows[:items, -1] = 1
        self.free = self.base + 1

    def __missing__(self, chunk: str) -> int:
        known, parts = self.model["words"], pieces(clean(chunk)) if len(chunk) < PIECE else [chunk]
        if not parts:
            at = self.base
        elif len(parts) > 1 or (at := known.get(parts[0])) is None or not self.base:
            at = self.free
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows[self.base :])])
            self.rows[at, :-1] = sum((self.one(p) for p in parts), np.float32(0))
            self.rows[at, -1] = len(parts)
            self.free += 1
        self[chunk] = at
        return at

    def logs(self, items: list[int]) -> np.ndarray:
        """Sum of the log frequencies of items of one kind."""
        if self.base:
            return self.rows[items, :-1].sum(axis=0)
        m = self.model
        out = m["base"][m["kind"][items[0]]] * np.float32(len(items))
        for i in items:
            a, b = m["starts"][i], m["starts"][i + 1]
            out[m["at"][a:b]] += m["gain"][a:b]
        return out

    def one(self, word: str) -> np.ndarray | np.float32:
        """Log frequencies of one word, by its n-grams if it is unseen."""
        known = self.model["grams"]
        if (i := self.model["words"].get(word)) is not None:
            return self.logs([i])
        for n in LENGTHS:
            if hits := [known[g] for g in grams(word, n) if g in known]:
                return self.logs(hits) / len(hits)
        return np.float32(0)

    def forget(self) -> None:
        self.clear()
        self.free = self.base + 1

    def score(self, text: str) -> tuple[str, float]:
        chunks = text.split()
        if len(text) >= PIECE and max(map(len, chunks), default=0) >= PIECE:
            chunks = [p for c in chunks for p in ([c] if len(c) < PIECE else pieces(clean(c)))]
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        sums = self.rows[at].sum(axis=0, dtype=np.float64)
        if len(self) > self.most:
            self.forget()
        if not sums[-1] or not self.model["langs"]:
            return "und", 0.0
        z = sums[:-1]
        best = int(z.argmax())  # languages stand in order, so ties go to the first by name
        return self.model["langs"][best], float(1 / np.exp(np.minimum(z - z[best], 0)).sum())


_scorers: dict[str, Scorer] = {}


def scorer(model: dict) -> Scorer:
    """This worker's scorer of the model, with the words it has met; kept between tasks."""
    if model["id"] not in _scorers:
        _scorers.clear()
        _scorers[model["id"]] = Scorer(model)
    return _scorers[model["id"]]


def predict(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """``carry``, lang_pred, score (posterior of the language under equal priors, 0 to 1) of each row of ``docs``.

    A null text, or one without a letter, gives ``und`` with score 0, as does a model that learned nothing. Repeated
    rows give repeated results; columns other than ``carry`` and text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], F.coalesce(F.col("text"), F.lit("")).alias("t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scorer(shared.value)
        for batch in batches:
            last = batch.num_columns - 1
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [known.score(t) for t in part.column(last).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*part.schema.names[:last], "lang_pred", "score"])

    out = inner.mapInArrow(work, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "lang_pred", "score")


def identify(docs: DataFrame, held_out_remainder: int = 1, folds: int = 3, **how: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on rows (doc_id, text, lang) outside the held-out fold.

    A row is held out if crc32 of its doc_id as text leaves ``held_out_remainder`` mod ``folds``; a null doc_id is not
    held out and not learned from.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = docs.select("doc_id", "text", "lang", (F.coalesce(fold, F.lit(-1)) == held_out_remainder).alias("held_out"), F.xxhash64("doc_id").alias("mark"))
    model = train(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), **how)
    return predict(rows, model, ["doc_id", "held_out"])
