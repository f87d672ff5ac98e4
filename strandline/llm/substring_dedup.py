"""Removal of word runs that stand elsewhere too, by compaction of a de Bruijn graph.

A window of ``window`` words is an edge of the graph, its first and last words but one its nodes. Consecutive windows
whose smallest ``anchor``-word k-mer (by hash, leftmost on ties) is the same occurrence form a path; equal windows have
equal anchors, so a window whose anchor stands once in the corpus cannot repeat, and its whole path is settled by one
row instead of one for each window.

1. Each text gives its paths: anchor, place, and a 128-bit digest of the words at that place.
2. A join on the anchor keeps paths whose anchor repeats. Where all occurrences of an anchor have one and the same path
   no node of it has a second neighbour: the path does not branch and is repeated as a whole; where paths differ, those
   that stand twice are.
3. Only windows of the other, branching paths (and of one occurrence of each path that stands twice) are compared one
   by one.
4. The places (text, first word, last word) of what repeats go back to the texts and mark the words to remove.

Hashes of anchors only bring places together. What is removed is settled by the words at the source coordinates: their
bytes, joined by spaces, have equal 128-bit digests (for paths and for single windows).

Scale: rows that are shuffled are about a fourteenth of the words, then only repeated paths; counts are combined before
each shuffle, and every join is of two stored tables, so that a hot key is split. Places are kept for each distinct
text (by two 64-bit hashes), so exact copies cost one mark. The texts themselves are shuffled twice, to meet branching
paths and to meet marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import save, ship, work_dir

WINDOW, ANCHOR = 35, 8


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
    for a, b in wordhash.pieces(sizes.to_pylist()):
        part = batch.slice(a, b - a)
        yield part, part.column(batch.schema.get_field_index(name)).to_pylist()


def _paths(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash) of each path of the texts."""
    h, counts = wordhash.word_hashes(texts)
    if len(h) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64))
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - starts[row]
    k = wordhash.mix(wordhash.run_hashes(h, anchor))
    low = np.uint64(0xFFFFFF)
    best = wordhash.lowest((k & ~low) | (place[: len(k)].astype(np.uint64) & low), window - anchor + 1)
    n = len(best)
    inside = np.flatnonzero(place[:n] + window <= counts[row[:n]])
    at = inside + ((best[inside] & low).astype(np.int64) - place[inside] & 0xFFFFFF)
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    a, b = inside[first], inside[last]
    return row[a], place[a].astype(np.int32), place[b].astype(np.int32), k[at[first]].view(np.int64)


def _digests(texts: list[bytes], row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """Two longs for the words lo to end of each row's text: halves of a 128-bit digest of their bytes."""
    out, at, words = [], -1, []
    for r, a, b in zip(row.tolist(), lo.tolist(), end.tolist()):
        if r != at:
            at, words = r, texts[r].split()
        out.append(xxhash.xxh3_128_digest(b" ".join(words[a:b])))
    two = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(two[:, k])) for k in (0, 1)]


def _spread(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of each entry of a column of lists of (lo, hi)."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_spans(docs: DataFrame, folder: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, spans): for each distinct text with repeated windows, the (first, last) words that they cover.

    ``docs``: k1, k2 (two hashes of the text) and text as binary. A repeated row makes its windows repeated.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                row, lo, hi, m = _paths(texts, window, anchor)
                keys = [pa.array(part.column(k).to_numpy()[row]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(lo), pa.array(hi), pa.array(m), *_digests(texts, row, lo, hi + window)], names=["k1", "k2", "lo", "hi", "m", "s", "s2"])

    found = save(docs.mapInArrow(paths, "k1 bigint, k2 bigint, lo int, hi int, m bigint, s bigint, s2 bigint"), folder, "all_paths")
    ends = [f("s" if k == 0 else "s2").alias(f"{f.__name__}{k}") for k in (0, 1) for f in (F.min, F.max)]
    anchors = found.groupBy("m").agg(F.count(F.lit(1)).alias("n"), *ends)
    anchors = save(anchors.filter("n > 1").select("m", ((F.col("min0") == F.col("max0")) & (F.col("min1") == F.col("max1"))).alias("whole")), folder, "anchors")
    again = save(found.join(anchors, "m").select("k1", "k2", "lo", "hi", "s", "s2", "whole"), folder, "paths")
    branching = again.filter(~F.col("whole"))
    one = F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")
    twice = save(branching.groupBy("s", "s2").agg(F.count(F.lit(1)).alias("n"), one).filter("n > 1").select("s", "s2", "one", F.lit(True).alias("twice")), folder, "twice")
    branching = save(branching.join(twice.drop("one"), ["s", "s2"], "left").select("k1", "k2", "lo", "hi", F.coalesce("twice", F.lit(False)).alias("twice")), folder, "branching")
    settled = again.filter("whole").select("k1", "k2", "lo", "hi").unionByName(branching.filter("twice").select("k1", "k2", "lo", "hi"))
    settled = settled.select("k1", "k2", "lo", (F.col("hi") + window - 1).alias("hi"))

    # Of a path that stands twice one occurrence is enough to show its windows to other paths.
    open_ = branching.filter(~F.col("twice")).select("k1", "k2", "lo", "hi").unionByName(twice.select("one.*")).distinct()
    open_ = save(open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), folder, "open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                row, lo, hi = _spread(part.column(3))
                n = hi - lo + 1
                which = np.repeat(np.arange(len(row)), n)
                place = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                keys = [pa.array(part.column(k).to_numpy()[row[which]]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(place.astype(np.int32)), *_digests(texts, row[which], place, place + window)], names=["k1", "k2", "lo", "h1", "h2"])

    each = docs.join(open_, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(windows, "k1 bigint, k2 bigint, lo int, h1 bigint, h2 bigint")
    each = save(each, folder, "windows")
    same = save(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), folder, "same")
    single = each.join(same, ["h1", "h2"]).select("k1", "k2", "lo", (F.col("lo") + window - 1).alias("hi"))
    spans = settled.unionByName(single).distinct()
    return save(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), folder, "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept text) of each row of ``docs`` (doc_id, text); with ``digest`` its SHA-256.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts anywhere else, the
    same text included; repeated rows are such places. Kept words are joined by one space (column ``text``, or
    ``kept_sha256``). Null and empty texts have no words. An empty table gives an empty result; columns other than
    doc_id and text are ignored.
    """
    ship(docs.sparkSession)
    folder = work_dir(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias("text"))
    spans = repeated_spans(keyed.select("k1", "k2", "text"), folder, window, anchor)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                n, gone, kept = [], [], []
                for t, s in zip(texts, part.column(2)):
                    words = t.split()
                    marks = np.zeros(len(words) + 1, np.int32)
                    if s.is_valid:
                        _, lo, hi = _spread(pa.array([s.as_py()], s.type))
                        np.add.at(marks, lo, 1)
                        np.add.at(marks, hi + 1, -1)
                        left = np.cumsum(marks[:-1]) == 0
                        words = [w for w, keeps in zip(words, left.tolist()) if keeps]
                    n.append(len(marks) - 1)
                    gone.append(len(marks) - 1 - len(words))
                    joined = b" ".join(words)
                    kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "text"
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, {name} string")
