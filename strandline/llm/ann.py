"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the smallest distance,
and are turned by a seeded random rotation, after which any first dimensions are a fair sample of a distance. Lists come
from k-means on a bounded sample. A query probes the lists nearest to it; in a list, vectors lie in column blocks and a
query adds up partial distances block by block. After each block a hypothesis test abandons candidates whose partial
distance, scaled to all dimensions, is above the current k-th distance by more than its error allows. What is left is
scored exactly, in double precision, on the original vectors.

How many lists to probe is set on the sample: the fewest that hold ``recall`` of its true neighbours. There is a list
for each ``list_rows`` vectors, up to ``most_lists``, and the sample has 16 vectors a list or more (131,072 at most).
Index and search cover every row; a query whose lists hold fewer than k others probes further ones. Scale: rows are dealt to cells (list, part of the list, part of its queries) of bounded size, so that a
hot list or many equal vectors are split; each cell returns k rows a query at
most, and beyond the nearest lists only what reaches their k-th score, merged by a rank per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, save, ship, work_dir

BLOCK = 16
#: Vectors of the sample for each list, at least.
SAMPLE_LIST = 16


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): rows with an id and a finite, non-zero vector of the most common length; equal rows once."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0)).distinct()


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(sample: np.ndarray, norm: float, lists: int, k: int, recall: float, seed: int, spread: int = 256) -> dict:
    """Rotation, centres and number of lists to probe from a sample of original vectors."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    x = turn(sample, norm, rotation)
    centres = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(12):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    q = sample[rng.permutation(len(sample))[:spread]]
    true = np.argsort(-(q @ sample.T), axis=1, kind="stable")[:, : k + 1]
    order = nearest(turn(q, None, rotation), centres, len(centres))
    rank = np.argsort(order, axis=1)  # list to place in the query's order
    needed = np.sort(np.take_along_axis(rank, near[true], axis=1).ravel()) if len(true) else np.zeros(1, np.int64)
    probe = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return {"rotation": rotation, "centres": centres, "probe": min(len(centres), probe), "norm": norm}


def turn(x: np.ndarray, norm: float | None, rotation: np.ndarray) -> np.ndarray:
    """Rotated vectors with the extra coordinate; without ``norm`` (queries) that is 0."""
    extra = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(0, norm**2 - (x * x).sum(axis=1)))
    return np.concatenate([x, extra[:, None]], axis=1).astype(np.float32) @ rotation


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, in order; a block of rows at a time."""
    own = (centres * centres).sum(axis=1)[None, :]
    step, out = max(1, (1 << 22) // len(centres)), [np.zeros((0, min(n, len(centres))), np.int64)]
    for k in range(0, len(x), step):
        distance = own - 2 * x[k : k + step] @ centres.T
        out.append(distance.argmin(axis=1)[:, None] if n == 1 else np.argsort(distance, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``v`` with ``q``, each added up component by component: equal rows score equally."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += v[:, j] * q[j]
    return out


def scan(query: np.ndarray, columns: list[np.ndarray], k: int, error: float, known: float) -> np.ndarray:
    """Places of candidates that survive: partial distances by column block, a test after each.

    ``known``: a squared distance within which k candidates are known already; without one, k survive at least.
    """
    n, d = columns[0].shape[1], sum(len(c) for c in columns)
    if n <= 2 * k:
        return np.arange(n)
    first = np.zeros(2 * k, np.float32)
    at = 0
    for c in columns:
        first += np.square(c[:, : 2 * k] - query[at : at + len(c), None]).sum(axis=0)
        at += len(c)
    limit = min(known, np.partition(first, k - 1)[k - 1])
    alive, part, at = np.arange(n), np.zeros(n, np.float32), 0
    for c in columns:
        part = part + np.square((c if len(alive) == n else c[:, alive]) - query[at : at + len(c), None]).sum(axis=0)
        at += len(c)
        # The scaled partial distance errs by a factor of about 1 +- error / sqrt(at) either way.
        keep = part * (d / at) <= limit * (1 + (error / np.sqrt(at) if at < d else 1e-4)) ** 2
        if np.count_nonzero(keep) < k:  # too many abandoned, as the test may err: the nearest so far stay
            best = np.argsort(part, kind="stable")[:k]
            keep[best[part[best] <= known * (1 + 1e-4)]] = True
        alive, part = alive[keep], part[keep]
        if len(alive) > k and at < d:
            limit = min(limit, np.partition(part, k - 1)[k - 1] * (d / at) * (1 + error / np.sqrt(at)) ** 2)
    return alive


def search(vectors: DataFrame, id_column: str, column: str, every: int = 20, k: int = 20, recall: float = 0.96, sample: int = 16_384, list_rows: int = 1000, most_lists: int = 8192, cell_rows: int = 4096, error: float = 2.1, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k nearest other rows.

    Nearest is the largest inner product of the original vectors in double precision; ties go to the smaller id. Rows
    without an id, and vectors that are null, zero, of another length than most, or hold a null or non-finite component
    take no part. A row never finds its own id. With fewer candidates than k all are returned. Rows equal in id and
    vector count once; of rows equal in id only, each is a candidate and a query, and the best 20 by score of all. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    folder = work_dir(spark)
    rows = save(usable(vectors, id_column, column), folder, "vectors")
    total, norm = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    kind = "query_id bigint, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], kind).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    lists = max(1, min(total // list_rows, most_lists))
    sample = max(sample, SAMPLE_LIST * lists)
    picked = rows if total <= sample else rows.filter(sampled(F.xxhash64(F.lit(seed), "id"), sample / total))
    model = fit(_matrix(picked.orderBy("id").limit(2 * sample).select("v").toArrow()["v"]), norm, lists, k, recall, seed)
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = turn(_matrix(batch.column(1)), m["norm"], m["rotation"])
            near = nearest(x, m["centres"], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near.astype(np.int32))], names=["id", "v", "x", "list"])

    index = save(rows.mapInArrow(place, "id bigint, v array<double>, x binary, list int"), folder, "index")
    held = np.zeros(len(model["centres"]), np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        held[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = turn(_matrix(batch.column(1)), None, m["rotation"])
            order = nearest(x, m["centres"], len(m["centres"]))
            # The lists that the sample asks for, and further ones until they hold k others, if there are so many.
            enough = (np.cumsum(sizes.value[order], axis=1) <= k).sum(axis=1) + 1
            n = np.minimum(np.maximum(enough, m["probe"]), order.shape[1])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(order[np.arange(order.shape[1]) < n[:, None]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in x], pa.binary()), lists], names=["id", "v", "x", "lists"])

    queries = save(rows.filter(F.col("id") % every == 0).mapInArrow(probe, "id bigint, v array<double>, x binary, lists array<int>"), folder, "queries")
    # First the nearest lists; their k-th score is the bar for what the other lists return.
    near = max(1, model["probe"] // 4)
    lists = queries.select("id", "v", "x", F.posexplode("lists").alias("place", "list"))

    def probed(asks: DataFrame) -> DataFrame:
        # Parts of each list and of the queries that probe it: a row for each list, of which there are ``most_lists`` at most.
        parts = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"))
        asked = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("askers"))
        shape = F.broadcast(parts.join(asked, "list"))
        mark = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), F.col(n)).cast("int")
        held = index.join(shape, "list").select("list", mark("parts").alias("part"), F.explode(F.expr("sequence(0, askers - 1)")).alias("asker"), F.lit(False).alias("asks"), F.lit(None).cast("double").alias("bar"), "id", "v", "x")
        asks = asks.join(shape, "list").select("list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), mark("askers").alias("asker"), F.lit(True).alias("asks"), "bar", "id", "v", "x")
        found = held.unionByName(asks).groupBy("list", "part", "asker").applyInArrow(cell, kind).distinct()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

    def cell(table: pa.Table) -> pa.Table:
        asking = table["asks"].to_numpy()
        ids, v = table["id"].to_numpy(), _matrix(table["v"])
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(len(ids), -1)
        of = np.flatnonzero(~asking)
        of = of[np.argsort(ids[of], kind="stable")]
        columns = [np.ascontiguousarray(x[of, a : a + BLOCK].T) for a in range(0, x.shape[1], BLOCK)]
        bars, top = table["bar"].to_numpy(), shared.value["norm"] ** 2
        own, his, scores = [], [], []
        for q in np.flatnonzero(asking) if len(of) else []:
            known = np.inf if np.isnan(bars[q]) else top + v[q] @ v[q] - 2 * bars[q]
            left = of[scan(x[q], columns, k + 1, error, known * (1 + 1e-4) + 1e-6)]
            left = left[ids[left] != ids[q]]
            s = inner(v[left], v[q])
            if np.isfinite(known):
                left, s = left[s >= bars[q]], s[s >= bars[q]]
            best = np.lexsort((ids[left], -s))[:k]
            own.append(np.full(len(best), ids[q]))
            his.append(ids[left][best])
            scores.append(s[best])
        join = lambda p, t: np.concatenate(p) if p else np.zeros(0, t)
        return pa.table({"query_id": pa.array(join(own, np.int64), pa.int64()), "vec_id": pa.array(join(his, np.int64), pa.int64()), "score": pa.array(join(scores, np.float64), pa.float64())})

    first = save(probed(lists.filter(F.col("place") < near).withColumn("bar", F.lit(None).cast("double"))), folder, "first")
    bars = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
    rest = probed(lists.filter(F.col("place") >= near).join(bars, "id", "left"))
    both = first.unionByName(rest).drop("rank").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
