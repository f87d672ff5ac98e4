"""Similarity join of texts on word shingles with a count-vector R-tree.

A text's shingles are hashed into groups; its counts of 2 ** 40 groups are its point, kept sparse. Folded to fewer
groups (sums of coordinates) a point stays a point, and in any of them the overlap of two texts is at most the sum of
the smaller coordinates. Points of similarity t or more differ in at most (1 - t) / (1 + t) of their joint size d.

1. Texts with equal sets form classes; from here on a class is one point.
2. Upper levels of the tree, dealt over the cluster: points are split by size band, then the coordinates of a band are
   dealt into d + 1 blocks. A pair within the bound has equal coordinates in one block at least, so a leaf is (band,
   block, the counts there, as a hash linear in them); a point stands in a leaf of each block of its bands. Leaves with
   one class are dropped by counting, before anything is joined: their counts go to a Bloom filter that keeps them from
   the shuffle.
3. In each leaf a hub is compared with the others: bound by summed minima over ``GROUPS`` folded coordinates, then exact
   intersection. Verified links give components. ``hub_rounds`` such rounds, the later ones with the members of most
   links as hubs, settle groups of near copies with one comparison a member and round.
4. Leaves that still hold several components are joined in full (of leaves with the same members one is): packed R-trees
   over blocks of at most ``leaf_points`` members prune nodes and points by the bound. A cell hands on its surviving
   pairs of different components if they are no more than its points; the few denser cells fetch their points' sets,
   verify inside and hand on only links that join components there. What leaves a cell is linear in its points.

Scale: leaf hashes, about a fifth of the shingles at 0.9 (a half at 0.8), are counted in one shuffle, combined before it.
Points are made only for classes in shared leaves, sets only for pairs within the bound. Bloom filters are sized by what
they hold, up to 2 ** ``MOST_BITS`` bits (32 MB, broadcast); texts wanted beyond that are found by a join. Hot leaves are
never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .bloom import MOST_BITS, Bloom
from .common import drop, save, ship, work_dir
from .components import components
from .rtree import CountTree

#: Coordinates of the points that are moved, and to which the trees' nodes fold them.
GROUPS, NODE_GROUPS = 4096, 256
#: Rows of cells that one call joins at about, and points of a cell that needs no tree.
BUCKET, SMALL = 2000, 24
#: Bytes of sets in one part of a leaf, two of which meet in a cell.
CELL_BYTES = 8 << 20


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words than ``words`` make one shingle."""
    h, counts = wordhash.word_hashes([t.lower() for t in texts])
    s = wordhash.mix(wordhash.run_hashes(h, words))
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(s[at : at + n - words + 1]))
        elif n:
            out.append(wordhash.mix(wordhash.run_hashes(h[at : at + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def groups(s: np.ndarray) -> np.ndarray:
    """The group of each element, of 2 ** 40."""
    return s >> np.uint64(24)


def class_of(s: np.ndarray) -> int:
    """64-bit identity of a set, signed."""
    x = np.uint64((int(wordhash.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) * 31 + len(s)) % 2**64)
    return int(wordhash.mix(np.array([x], np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands and their blocks for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        step = 0.8 if num * 100 >= den * 88 else 0.6
        self.low = [1]
        while self.low[-1] < 2**40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] / step)))

    def apart(self, x: int, y: int) -> int:
        """Most elements in which sets of these sizes can differ."""
        return (self.den - self.num) * (x + y) // (self.den + self.num)

    def levels(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(level, blocks, most differences with any partner there) for a set of ``n`` elements."""
        largest = n * self.den // self.num
        k = int(np.searchsorted(self.low, n, "right")) - 1
        while self.low[k] <= largest:
            top = self.low[k + 1] - 1
            blocks = self.apart(top, top) + 1
            if blocks > 1:
                yield k, blocks, self.apart(n, min(top, largest))
            k += 1

    def leaves(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the leaves in which the set's point stands."""
        out, group = [], groups(s)
        unit = wordhash.mix(group + np.uint64(0x632BE59BD9B4E019))  # what one count of the group adds to a leaf's hash
        for k, blocks, differences in self.levels(len(s)):
            block = (wordhash.mix(group + np.uint64(k)) % np.uint64(blocks)).astype(np.int64)
            sums, held = np.zeros(blocks, np.uint64), np.bincount(block, minlength=blocks)
            np.add.at(sums, block, unit)
            keys = wordhash.mix(wordhash.mix(sums) + np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD6E8FEB86659FD93 % 2**64))
            # With fewer empty blocks than blocks that must agree, one that agrees is not empty.
            empty = held == 0
            out.append(keys if blocks - differences <= int(empty.sum()) else keys[~empty])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for a, b in wordhash.pieces(sizes):
            part = batch.slice(a, b - a)
            yield part, part.column(part.schema.get_field_index(name)).to_pylist()


def _sets(texts: DataFrame, wanted: DataFrame, words: int, points: bool) -> DataFrame:
    """(f, n, data) of texts (k, text) whose hash k may be in the stored table ``wanted`` (k): points, or else all elements."""
    count, bloom = wanted.count(), None
    if 10 * count < 2**MOST_BITS:
        bloom = texts.sparkSession.sparkContext.broadcast(Bloom.of(wanted.select(F.col("k").alias("f")), count))
    else:
        texts = texts.join(wanted.select("k").distinct().hint("merge"), "k", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _batches(batches, "text"):
            held = bloom.value.held(part.column(0).to_numpy()) if bloom else np.ones(len(batch), bool)
            sets = shingle_sets([t for t, h in zip(batch, held.tolist()) if h], words)
            data = [packed(s) if points else s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(data, pa.binary())], names=["f", "n", "data"])

    return texts.select("k", "text").mapInArrow(work, "f bigint, n bigint, data binary").groupBy("f").agg(F.first("n").alias("n"), F.first("data").alias("data"))


def packed(s: np.ndarray) -> bytes:
    """The point of a set: steps between its sorted groups in a byte each (255: go on without a count), or all counts."""
    group = np.sort((groups(s) % np.uint64(GROUPS)).astype(np.int64))
    step = np.diff(group, prepend=0)
    if len(s) + int((step // 255).sum()) < GROUPS:
        out = np.full(len(s) + int((step // 255).sum()), 255, np.uint8)
        out[np.cumsum(step // 255 + 1) - 1] = step % 255
        return out.tobytes()
    counts = np.bincount(group, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


class Points:
    """Points from what ``packed`` made: (row, group) of each count, to be folded to any number of groups."""

    def __init__(self, data: list[bytes]):
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        steps = np.frombuffer(b"".join(x for x in data if len(x) < GROUPS), np.uint8)
        short = np.flatnonzero(sizes < GROUPS)
        row = np.repeat(short, sizes[short])
        upto = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate([[0], upto])[np.cumsum(sizes[short]) - sizes[short]] if len(short) else upto
        counted = steps != 255
        found = [(row[counted], (upto - np.repeat(before, sizes[short]))[counted], np.ones(int(counted.sum()), np.int64))]
        for i in np.flatnonzero(sizes >= GROUPS).tolist():
            counts = np.frombuffer(data[i], np.uint8 if len(data[i]) == GROUPS else np.uint32)
            at = np.flatnonzero(counts)
            found.append((np.full(len(at), i), at, counts[at].astype(np.int64)))
        self.row, self.group, self.weight = (np.concatenate(x) for x in zip(*found))
        self.rows = len(data)

    def counts(self, groups: int, chosen: np.ndarray | None = None) -> np.ndarray:
        """A row of counts of each point, or of the ``chosen`` ones in ascending order."""
        row, group, weight, rows = self.row, self.group, self.weight, self.rows
        if chosen is not None:
            place = np.full(rows, -1)
            place[chosen] = np.arange(len(chosen))
            kept = place[row] >= 0
            row, group, weight, rows = place[row[kept]], group[kept], weight[kept], len(chosen)
        wide = weight.sum() > 65_535
        out = np.zeros((rows, groups), np.uint32 if wide else np.uint16)
        np.add.at(out.ravel(), row * groups + group % groups, weight.astype(out.dtype))
        return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def within(pa_: Points, na: np.ndarray, pb: Points, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Places of the pairs (row i of each) whose bound on the overlap allows a similarity of num / den."""
    left = np.flatnonzero((na * den >= nb * num) & (nb * den >= na * num))
    for groups_ in (NODE_GROUPS, GROUPS):
        if len(left):
            bound = np.minimum(pa_.counts(groups_, left), pb.counts(groups_, left)).sum(axis=1, dtype=np.int64)
            left = left[bound * (num + den) >= num * (na + nb)[left]]
    return left


def overlap(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())


def _apart(root: np.ndarray, part: np.ndarray, two: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Of the pairs of rows of cells, those of different components and, where ``two`` parts meet, of different parts."""
    i, j = found.T
    return (root[i] != root[j]) & (~two[i] | (part[i] != part[j]))


def _linked(standing: DataFrame, texts: DataFrame, words: int, bands: Bands, folder: str, leaf_points: int, hub_rounds: int) -> DataFrame:
    """(node, root) of the classes that are linked with another; ``standing`` has k, f and the leaves of each text."""
    spark, num, den = standing.sparkSession, bands.num, bands.den
    # Leaves that hold two texts or more, as a Bloom filter, keep the many others from being shuffled with their classes.
    often = save(standing.select(F.explode("leaves").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f"), folder, "often")
    bloom = spark.sparkContext.broadcast(Bloom.of(often, often.count()))

    def shared_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            f, n, leaf = np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), lists.flatten().to_numpy()
            held = bloom.value.held(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(f[held]), pa.array(n[held]), pa.array(leaf[held])], names=["f", "n", "leaf"])

    found = save(standing.select("f", "n", "leaves").mapInArrow(shared_leaves, "f bigint, n bigint, leaf bigint"), folder, "found")
    leaves = found.groupBy("leaf").agg(F.min(F.struct("f", "n")).alias("hub"), F.max("f").alias("other")).filter("hub.f <> other")
    leaves = save(leaves.select("leaf", F.col("hub.f").alias("hub"), F.col("hub.n").alias("hub_n")), folder, "leaves")
    members = save(found.join(leaves, "leaf").select("leaf", "hub", "hub_n", "f", "n").distinct(), folder, "members")
    shared = save(members.select("f").distinct(), folder, "shared")
    texts_of = save(standing.groupBy("f").agg(F.min("k").alias("k")).join(shared, "f"), folder, "texts_of")
    for done in ("standing", "often", "found"):  # the largest tables; nothing reads them from here on
        drop(spark, f"{folder}/{done}")
    points = save(_sets(texts, texts_of, words, True), folder, "points")

    def side(table: DataFrame, c: str) -> DataFrame:
        return table.select(F.col("f").alias(c), F.col("n").alias(f"n{c}"), F.col("data").alias(f"d{c}"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, da, nb, db = batch.columns
            near = pa.array(within(Points(da.to_pylist()), na.to_numpy(), Points(db.to_pylist()), nb.to_numpy(), num, den))
            yield pa.RecordBatch.from_arrays([a.take(near), b.take(near)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5))):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = overlap(u, v)
                if both * den >= num * (len(u) + len(v) - both):
                    good.append(i)
            good = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["a", "b"])

    def elements(wanted: DataFrame, name: str) -> DataFrame:
        """All elements of the classes f of ``wanted``."""
        return save(_sets(texts, save(wanted.distinct().join(texts_of, "f"), folder, f"{name}_wanted"), words, False), folder, f"{name}_elements")

    def verify(near: DataFrame, name: str) -> DataFrame:
        """Links among the stored pairs (a, b) within the bound."""
        sets = elements(near.select(F.col("a").alias("f")).union(near.select("b")), name)
        joined = near.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "na", "da", "nb", "db")
        links = save(joined.mapInArrow(exact, "a bigint, b bigint"), folder, f"{name}_links")
        for done in ("near", "wanted", "elements"):
            drop(spark, f"{folder}/{name}_{done}")
        return links

    # Rounds of hubs: each leaf's hub is compared with its members of other components. After the first round it is the
    # member with the most links so far that has not been one, as is the text of which others are edited copies.
    sized = (F.col("n") * den >= F.col("hub_n") * num) & (F.col("hub_n") * den >= F.col("n") * num)
    who = [F.bit_xor(F.xxhash64(F.lit(k), "f")).alias(f"who{k}") for k in (0, 1)]
    asked, links = members.select("leaf", "hub", "hub_n", F.col("hub").alias("hub_root"), "f", "n", F.col("f").alias("root")), None
    for k in range(hub_rounds):
        pairs = asked.filter(sized & (F.col("f") != F.col("hub")) & (F.col("root") != F.col("hub_root")))
        pairs = save(pairs.select(F.col("hub").alias("a"), F.col("f").alias("b")).distinct(), folder, f"pairs{k}")
        joined = pairs.join(side(points, "a"), "a").join(side(points, "b"), "b").select("a", "b", "na", "da", "nb", "db")
        new = verify(save(joined.mapInArrow(bounded, "a bigint, b bigint"), folder, f"hub{k}_near"), f"hub{k}")
        drop(spark, f"{folder}/pairs{k}")
        if k and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        roots = components(links, folder, f"hub{k}_roots")
        placed = members.select("leaf", "f", "n").join(roots, F.col("f") == F.col("node"), "left").select("leaf", "f", "n", F.coalesce("root", "f").alias("root"))
        placed = save(placed, folder, f"placed{k}")
        # Two members are the hub and one that was compared with it. Leaves with the same members hold the same pairs.
        open_ = placed.groupBy("leaf").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"), *who)
        open_ = open_.filter("r1 <> r2 and members > 2").groupBy("who0", "who1", "members", "size").agg(F.min("leaf").alias("leaf"))
        open_ = save(open_.select("leaf", "members", "size"), folder, f"open{k}")
        hubs = asked.select("leaf", "hub").distinct() if k == 0 else hubs.select("leaf", "hub").union(past)
        past = save(hubs.join(open_, "leaf").select("leaf", "hub"), folder, f"past{k}")
        members = save(placed.join(open_, "leaf").select("leaf", "f", "n", "root"), folder, f"members{k}")
        drop(spark, f"{folder}/placed{k}")
        linked = links.select(F.col("a").alias("of")).union(links.select("b")).groupBy("of").agg(F.count(F.lit(1)).alias("links"))
        fresh = members.join(past, (members["leaf"] == past["leaf"]) & (F.col("f") == F.col("hub")), "left_anti").join(linked, F.col("f") == F.col("of"), "left")
        best = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "f", "n", "root")).alias("best")
        hubs = fresh.groupBy("leaf").agg(best).select("leaf", F.col("best.f").alias("hub"), F.col("best.n").alias("hub_n"), F.col("best.root").alias("hub_root"))
        hubs = save(hubs, folder, f"hubs{k}")
        asked = members.join(hubs, "leaf")
    parts = F.greatest(F.ceil(F.col("members") / leaf_points), F.least(F.col("members"), F.ceil(F.col("size") * 8 / CELL_BYTES)))
    open_ = open_.select("leaf", parts.cast("int").alias("parts"))
    rest = members.join(open_, "leaf").withColumn("part", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    # Any two parts of a leaf meet in one cell, named by the smaller and the larger part.
    cells = rest.withColumn("with", F.explode(F.expr("sequence(0, parts - 1)"))).select("leaf", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "f", "root", "part")
    cells = save(cells, folder, "cells")
    cell = ["leaf", "i", "j"]
    # Most cells are small: several are worked on in one call, about BUCKET rows of them.
    buckets = max(1, -(-cells.count() // BUCKET))

    def tree_join(table: pa.Table) -> pa.Table:
        """The pairs of different components within the bound; of a cell that has more of them than points, its name."""
        table = table.sort_by([(c, "ascending") for c in [*cell, "f"]]).combine_chunks()
        names = np.stack([table[c].to_numpy() for c in cell], axis=1)
        starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1)))
        ends = np.append(starts[1:], len(names))
        n, f, root, part = (table[c].to_numpy() for c in ("n", "f", "root", "part"))
        held = Points(table["data"].to_pylist())
        nodes, found = held.counts(NODE_GROUPS), []
        for a, b in zip(starts.tolist(), ends.tolist()):
            found.append(CountTree(n[a:b], nodes[a:b]).pairs(num, den) + a if b - a > SMALL else np.stack(np.triu_indices(b - a, 1), axis=1) + a)
        found = np.concatenate(found)
        found = found[_apart(root, part, names[:, 1] != names[:, 2], found)]
        x, y = found.T
        found = found[(n[x] * den >= n[y] * num) & (n[y] * den >= n[x] * num)]
        for counts in (nodes, None):
            counts, near = held.counts(GROUPS) if counts is None else counts, []
            for k in range(0, len(found), 1 << 11):
                x, y = found[k : k + (1 << 11)].T
                near.append(np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64) * (num + den) >= num * (n[x] + n[y]))
            found = found[np.concatenate(near)] if near else found
        of = np.searchsorted(starts, found[:, 0], "right") - 1
        dense = np.bincount(of, minlength=len(starts)) > ends - starts
        found, of = found[~dense[of]], of[~dense[of]]
        pairs, rows = np.sort(f[found], axis=1), np.concatenate([starts[of], starts[dense]])
        void = np.arange(len(rows)) >= len(pairs)
        two = [pa.array(np.concatenate([pairs[:, k], np.zeros(int(dense.sum()), np.int64)]), pa.int64(), mask=void) for k in (0, 1)]
        return pa.table({**{c: pa.array(names[rows, k], pa.int32() if k else pa.int64()) for k, c in enumerate(cell)}, "a": two[0], "b": two[1]})

    def set_join(table: pa.Table) -> pa.Table:
        """Exact links of different components in one cell, only such as join components there."""
        table = table.sort_by("f")
        f, n, root = (table[c].to_numpy() for c in ("f", "n", "root"))
        sets = [np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()]
        of, links = {r: r for r in root.tolist()}, []

        def top(x: int) -> int:
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        counts = np.stack([np.bincount((groups(s) % np.uint64(NODE_GROUPS)).astype(np.int64), minlength=NODE_GROUPS) for s in sets])
        found = CountTree(n, counts.astype(np.uint32)).pairs(num, den)
        for i, j in found[_apart(root, table["part"].to_numpy(), np.repeat(table["i"][0] != table["j"][0], len(f)), found)].tolist():
            a, b = top(int(root[i])), top(int(root[j]))
            if a != b:
                both = overlap(sets[i], sets[j])
                if both * den >= num * (n[i] + n[j] - both):
                    of[max(a, b)] = min(a, b)
                    links.append(sorted((int(f[i]), int(f[j]))))
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

    near = save(cells.join(points, "f").groupBy(F.pmod(F.xxhash64(*cell), F.lit(buckets))).applyInArrow(tree_join, "leaf bigint, i int, j int, a bigint, b bigint"), folder, "survivors")
    more = verify(save(near.filter("a is not null").select("a", "b").distinct(), folder, "tree_near"), "tree")
    dense = save(near.filter("a is null").select(*cell), folder, "dense")
    if not dense.isEmpty():
        inside = save(cells.join(dense, cell), folder, "inside")
        sets = elements(inside.select("f"), "dense")
        more = more.union(save(inside.join(sets, "f").groupBy(*cell).applyInArrow(set_join, "a bigint, b bigint"), folder, "dense_links"))
    return roots if more.isEmpty() else components(links.union(more), folder, "roots")


def similar_texts(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, leaf_points: int = 400, hub_rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two rows link when intersection over union of their shingle sets is num / den or more; component_id is the smallest
    doc_id reachable by links. A null text or one without words has no shingles and links with nothing: its
    component_id is its own doc_id. Rows with equal doc_id are judged each by its own text. Null doc_ids are never a
    smallest one. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    folder, bands = work_dir(spark), Bands(num, den)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("k"), text.cast("binary").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _batches(batches, "text"):
            sets = shingle_sets(batch, words)
            keys = [bands.leaves(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), leaves]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "n", "f", "leaves"])

    standing = save(texts.mapInArrow(measure, f"doc_id {kind}, k bigint, n bigint, f bigint, leaves array<bigint>"), folder, "standing")
    measured = save(standing.select("doc_id", "n", "f"), folder, "measured")
    roots = _linked(standing, texts.select("k", "text"), words, bands, folder, leaf_points, hub_rounds)
    first = measured.filter("n > 0").groupBy("f").agg(F.min("doc_id").alias("low"))
    first = first.join(roots, F.col("f") == F.col("node"), "left").select("f", "low", F.coalesce("root", "f").alias("root"))
    first = save(first, folder, "first")
    lowest = save(first.groupBy("root").agg(F.min("low").alias("least")), folder, "lowest")
    named = save(first.join(lowest, "root").select(F.col("f").alias("of"), "least"), folder, "named")
    out = measured.join(named, (F.col("f") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
