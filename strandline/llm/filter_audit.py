"""Audit of how filters interact: what each removes under every order, what it alone removes, and what it costs.

Filters, labels and parts of the corpus become packed bitmaps, a bit a row, partition by partition. For each set of
filters the rows that pass all of them are an AND-NOT over the bitmaps and a population count; the counts of partitions
add up, and every order of the filters is read from the counts of its prefixes. So the rows are read once, whatever the
number of orders.

Scale: texts are read once and leave a few bytes a row. Equal texts are found by one aggregate over 128-bit digests; the
smallest id of each joins back on digest and id together, so a text that a third of all rows share is spread over all
tasks. After that only counts move: 2 ** filters rows for each part and partition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, ship, work_dir

#: Parts whose counts one task holds before it hands them on.
MOST_PARTS = 4096

_UPPER, _CONTINUED, _MARK = bytes(range(65, 91)), bytes(range(128, 192)), re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """Bits of the failed conditions A (1) to D (8) of a UTF-8 text."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | (_MARK.search(text) is not None) << 3


def measured(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, fails, digest) of whole texts: failed conditions A to D, and 128 bits of a digest of the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fails, digests = [], []
            for x in texts:
                t = x.as_py()
                fails.append(failures(t))
                digests.append(hashlib.sha256(t).digest()[:16])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    return rows.mapInArrow(work, "doc_id bigint, part string, fails int, digest binary")


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with ``repeats``: some smaller doc_id has the same digest.

    A null doc_id is neither smaller than another nor repeats one; rows of one doc_id do not repeat each other.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "of")
    joined = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    return joined.withColumn("repeats", F.col("first").isNull() & F.col("doc_id").isNotNull()).drop("of", "first")


def subset_counts(rows: DataFrame, part: str, fails: str, marks: list[str], filters: int) -> DataFrame:
    """(part, passed, n, one column for each of ``marks``): rows that fail none of the filters in the bits of ``passed``.

    ``fails`` holds a bit for each of ``filters`` filters that the row fails; ``marks`` are booleans, of which rows that
    have them are counted too. Null marks count as false.
    """
    ship(rows.sparkSession)
    subsets = 1 << filters
    names = [f"m{k}" for k in range(len(marks))]
    inner = rows.select(F.col(part).alias("part"), F.col(fails).cast("int").alias("fails"), *[F.coalesce(F.col(m), F.lit(False)).alias(n) for m, n in zip(marks, names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            who, found = list(held), np.concatenate([*held.values()])
            columns = [pa.array(np.repeat(np.arange(len(who)), subsets)).cast(pa.int32()), pa.array(np.tile(np.arange(subsets, dtype=np.int32), len(who)))]
            columns[0] = pa.DictionaryArray.from_arrays(columns[0], pa.array(who, pa.string())).cast(pa.string())
            columns += [pa.array(found[:, k]) for k in range(1 + len(marks))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "passed", "n", *names])

        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            failed = batch.column(1).to_numpy()[order]
            marked = [np.asarray(batch.column(2 + k))[order] for k in range(len(marks))]
            ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
            for who, a, b in zip(coded.dictionary.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                bits = [np.packbits((failed[a:b] >> k & 1).astype(bool)) for k in range(filters)]
                labels = [np.packbits(m[a:b].astype(bool)) for m in marked]
                alive = [np.packbits(np.ones(b - a, bool))]
                counts = held.setdefault(who, np.zeros((subsets, 1 + len(marks)), np.int64))
                for s in range(subsets):
                    if s:  # the set without its lowest filter, AND-NOT that filter
                        low = (s & -s).bit_length() - 1
                        alive.append(alive[s & (s - 1)] & ~bits[low])
                    counts[s, 0] += int(np.bitwise_count(alive[s]).sum(dtype=np.int64))
                    for k, label in enumerate(labels):
                        counts[s, 1 + k] += int(np.bitwise_count(alive[s] & label).sum(dtype=np.int64))
            if len(held) >= MOST_PARTS:
                yield out()
        if held:
            yield out()

    kinds = "part string, passed int, n bigint" + "".join(f", {n} bigint" for n in names)
    summed = inner.mapInArrow(work, kinds).groupBy("part", "passed").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    return summed.select("part", "passed", "n", *[F.col(n).alias(m) for m, n in zip(marks, names)])


def orders(counts: DataFrame, filters: str, marks: list[str]) -> DataFrame:
    """What each step of every order of ``filters`` (a letter each, lowest bit first) keeps and removes, for each part.

    ``counts`` is what ``subset_counts`` returns. Returns (part, filter_order, step, kept, removed, redundant,
    unique_fails, shapley) and, for each of ``marks``, <mark>_lost: its rows removed at the step.
    """
    n, every = len(filters), (1 << len(filters)) - 1
    fields = ["n", *marks]
    # 2 ** filters rows of a part meet: a number that does not grow with the corpus.
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("passed", F.struct(*fields)))).alias("of"))

    def passing(subset: Column, field: str = "n") -> Column:
        return F.col("of")[subset][field]

    texts = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = by_part.withColumn("filter_order", F.explode(texts)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bit(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")
    after = before.bitwiseOR(own)
    weights = F.array(*[F.lit(factorial(s.bit_count()) * factorial(max(0, n - 1 - s.bit_count()))).cast("long") for s in range(every + 1)])
    # Orders in which just the filters of s come before: s! ways of those, and of the others after.
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(every)), F.lit(0).cast("long"), lambda sum_, s: sum_ + F.when(s.bitwiseAND(own) == 0, F.get(weights, s) * (passing(s) - passing(s.bitwiseOR(own)))).otherwise(F.lit(0).cast("long")))
    removed = passing(before) - passing(after)
    lost = [(passing(before, m) - passing(after, m)).alias(f"{m}_lost") for m in marks]
    return rows.select(
        "part", "filter_order", "step", passing(after).alias("kept"), removed.alias("removed"), (passing(F.lit(0)) - passing(own) - removed).alias("redundant"),
        (passing(F.lit(every) - own) - passing(F.lit(every))).alias("unique_fails"), *lost, shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The five filters' interaction over ``docs`` (doc_id, text and ``part``), with ``labels`` (doc_id, quality, toxic).

    A: under 200 words; B: fewer distinct words than half the words; C: more than 3 % of the characters A to Z; D: holds
    one of ``#$%&*|``; E: the text of a smaller doc_id. A null text is an empty one, a null part an empty string. Several
    labels of one doc_id count as good (toxic) if any is. Repeated rows count each. An empty table gives an empty result.
    """
    folder = work_dir(docs.sparkSession)
    rows = repeats(save(measured(docs, part), folder, "measured"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(known, F.col("doc_id") == F.col("of"), "left")
    rows = rows.withColumn("fails", F.col("fails") + F.when(F.col("repeats"), F.lit(16)).otherwise(F.lit(0)))
    counts = save(subset_counts(rows, "part", "fails", ["good", "toxic"], 5), folder, "counts")
    return orders(counts, "ABCDE", ["good", "toxic"])
