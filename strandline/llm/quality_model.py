"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers (the quality rules, insult words, and human labels where a table of them is given) vote
on a sample of documents. Expectation-maximisation on counted vote patterns estimates how reliable each is, people
included: a human label is one vote more, with a prior of few errors, and may be outvoted. The posterior of a document
on which any labeller votes is its training label, for quality and for civility apart. A logistic model over hashed
word, word-start and shape features learns from these and scores every whole text.

Civility is judged by a short list of insults and, where labels are given, by words that stand in far more toxic documents
than others, in whatever language: a labeller of its own, learned on one half of the labelled documents to vote on the
other, so that a document's words and its human label err apart. Without labels the list votes alone: its rates are then
the prior's.

Fitting sees at most about ``sample`` documents with and without human labels, chosen by a hash of doc_id; their
features (hashes of distinct words, not texts) meet in one task of bounded size. The model is two numbers for each of at
most ``2 ** bits`` features, which is what is broadcast. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import sampled, save, ship, work_dir

FAMILIES = ("quality", "civility")
#: Insults that the word labellers look for, with or without labels.
INSULTS = ("idiot", "loser", "moron", "scum", "stupid", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "jerk", "filth", "vermin", "retard", "bastard")
#: Probabilities of a bad, no and good human label among bad and among good documents, before any is seen.
HUMAN = {-1: (0.60, 0.01), 0: (0.39, 0.39), 1: (0.01, 0.60)}
#: Entries that a worker's cache of words holds before it starts afresh.
CACHE = 500_000


def labellers(labelled: bool) -> dict[str, dict[str, Column]]:
    """Votes (1 good, -1 bad, 0 abstains) of each family, from columns of quality_rules.measures, insults and labels."""
    hits = F.col("insults")
    found = {
        "quality": quality_rules.votes(),
        "civility": {"insult": F.when(hits >= 1, -1).otherwise(0)},
    }
    if labelled:
        found["civility"]["learned"] = F.when(F.col("learned") >= 1, -1).otherwise(0)
        found["quality"]["label"] = F.when(F.col("given_quality") == 0, -1).when(F.col("given_quality") == 1, 1).otherwise(0)
        found["civility"]["label"] = F.when(F.col("given_toxic") == 1, -1).when(F.col("given_toxic") == 0, 1).otherwise(0)
    return found


class Features(dict):
    """A chunk between white space to the hashes of its word and of its word's start, or of its marks."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def of(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(name) & self.mask

    def __missing__(self, chunk: str) -> tuple[int, int]:
        word = chunk.strip(".,;:!?\"'()[]").lower()
        core = word.rstrip("#*$%&|<>")
        if not core:
            pair = (self.of(f"mark {word[:4]}"),) * 2
        elif len(core) < len(word):
            pair = self.of(f"word {core}"), self.of(f"ends {word[len(core):][:4]}")
        else:
            pair = self.of(f"word {core}"), self.of(f"start {core[:5]}")
        self[chunk] = pair
        return pair

    def document(self, text: str) -> np.ndarray:
        """Distinct features of a text; its length, share of distinct words and of distinct lines are features too."""
        chunks = text.split()
        at = np.unique(np.array([f for c in set(chunks) for f in self[c]], np.int64)) if chunks else np.zeros(0, np.int64)
        lines = [x for x in text.split("\n") if x.strip()]
        shape = [f"length {len(chunks).bit_length()}", f"fresh words {10 * len(set(chunks)) // max(1, len(chunks))}", f"fresh lines {5 * len(set(lines)) // max(1, len(lines))}"]
        if len(self) > CACHE:
            self.clear()
        return np.concatenate([at, np.array([self.of(s) for s in shape], np.int64)])


def fit(features: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 150, least_z: float = 4.0, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic model on binary features, of which only significant ones take part."""
    counts = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
    base = float(np.clip(target.mean(), 0.01, 0.99)) if len(target) else 0.5
    n = np.bincount(flat, minlength=size)
    good = np.bincount(flat, weights=np.repeat(target, counts), minlength=size)
    z = (good - n * base) / np.sqrt(np.maximum(n, 1) * base * (1 - base) + 1)
    chosen = np.flatnonzero((np.abs(z) >= least_z) & (n >= 5))
    weights, bias = np.zeros(size), float(np.log(base / (1 - base)))
    if not len(chosen):
        return weights, bias
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    row, col = np.repeat(np.arange(len(features)), counts), place[flat]
    row, col = row[col >= 0], col[col >= 0]
    w, v = np.zeros(len(chosen)), np.zeros(len(chosen))
    step, grown = 1.0, 1e-8 * np.ones(len(chosen))
    b, gb = bias, 1e-8
    for _ in range(rounds):  # gradient steps scaled by each feature's own past gradients
        margin = b + np.bincount(row, weights=w[col], minlength=len(features))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        g = np.bincount(col, weights=error[row], minlength=len(chosen)) + ridge * w
        v = 0.7 * v + g
        grown += g * g
        gb += error.sum() ** 2
        w -= step * 0.3 * v / np.sqrt(grown)
        b -= 0.3 * error.sum() / np.sqrt(gb)
    weights[chosen] = w
    return weights, b


def spoken(text: str) -> Column:
    """Lower-case runs of letters of a text."""
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+")


def insult_words(told: DataFrame) -> list[str]:
    """Words of far more toxic than other documents of ``told`` (text, given_toxic): 5 times the share, and no chance find.

    All of them: at most one for each five words of the toxic documents of the sample.
    """
    totals = told.groupBy("given_toxic").count().collect()
    n = {r["given_toxic"]: r["count"] for r in totals}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return []
    each = told.select("given_toxic", F.explode(F.array_distinct(spoken("text"))).alias("w")).filter("w <> ''")
    each = each.groupBy("w").agg(F.count_if(F.col("given_toxic") == 1).alias("b"), F.count_if(F.col("given_toxic") == 0).alias("g")).filter("b >= 5")
    base = F.lit(bad / (bad + good))
    z = (F.col("b") - (F.col("b") + F.col("g")) * base) / F.sqrt((F.col("b") + F.col("g")) * base * (1 - base) + 1)
    often = (F.col("b") / bad >= 5 * (F.col("g") + 1) / good) & (z >= 5)
    return [r["w"] for r in each.filter(often).orderBy("w").collect()]


def posteriors(rows: DataFrame, families: dict[str, dict[str, Column]]) -> list[Column]:
    """For each family the posterior of each row of ``rows`` by its votes, null where none of its labellers votes."""
    beliefs = []
    for family, given in families.items():
        names = [f"{family}_{name}" for name in given]
        patterns = sorted((tuple(r[:-1]), r[-1]) for r in rows.groupBy(*names).agg(F.count(F.lit(1))).collect())  # at most 3 ** voters
        human = {list(given).index("label"): HUMAN} if "label" in given else None
        share, rates = quality_rules.estimate(patterns, len(names), priors=human)
        z = F.lit(float(np.log(share / (1 - share))))
        for name, rate in zip(names, rates):
            z = z + F.when(F.col(name) < 0, quality_rules.evidence(rate, -1)).when(F.col(name) > 0, quality_rules.evidence(rate, 1)).otherwise(quality_rules.evidence(rate, 0))
        belief = 1 / (1 + F.exp(-z))
        if any(1 in p for p, _ in patterns):  # where some vote is for good, a document without any vote says nothing
            belief = F.when(F.greatest(*[F.abs(name) for name in names]) > 0, belief)
        beliefs.append(belief.alias(family))
    return beliefs


def train(docs: DataFrame, labels: DataFrame | None, folder: str, sample: int, bits: int) -> dict:
    """The scorer's weights from a bounded sample of ``docs`` (doc_id, text)."""
    pool = docs.filter(F.col("doc_id").isNotNull())
    total = pool.select("doc_id").count()
    if total > sample:
        pool = pool.filter(sampled(F.xxhash64("doc_id"), sample / total))
    if labels is not None:
        given = labels.select(F.col("doc_id").alias("of"), F.col("quality").alias("given_quality"), F.col("toxic").alias("given_toxic")).filter("of is not null")
        given = given.groupBy("of").agg(F.min("given_quality").alias("given_quality"), F.max("given_toxic").alias("given_toxic"))
        pool = pool.join(given, F.col("doc_id") == F.col("of"), "left").drop("of")
    pool = save(pool, folder, "pool")
    if total and pool.isEmpty():
        raise ValueError("no document is in the sample")
    said = spoken("text")
    hits = lambda lexicon: F.size(F.filter(said, lambda w: w.isin(*lexicon))) if lexicon else F.lit(0)
    pool = pool.withColumn("insults", hits(INSULTS))
    if labels is not None:
        # Words are learned on one half of the labelled documents and vote on the other, so that no document is judged
        # by words that its own label has picked.
        half = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(2))
        told = pool.select("text", "given_toxic", half.alias("half")).filter("given_toxic is not null")
        lexicons = [sorted({*insult_words(told.filter(F.col("half") == 1 - k))} - {*INSULTS}) for k in (0, 1)]
        pool = pool.withColumn("learned", F.when(half == 0, hits(lexicons[0])).otherwise(hits(lexicons[1])))
    rows = save(quality_rules.measures(pool, pool.columns), folder, "measured")
    families = labellers(labels is not None)
    votes = {f"{f}_{name}": v for f, given in families.items() for name, v in given.items()}
    rows = rows.select("doc_id", "text", *[v.alias(name) for name, v in votes.items()])
    believed = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *posteriors(rows.drop("text"), families))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features(bits)
        for batch in batches:
            found = [maker.document(t) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=["doc_id", "at", *FAMILIES])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        features = [np.asarray(x.values) for x in table["at"]]
        out = []
        for k, family in enumerate(FAMILIES):
            target = table[family].to_numpy(zero_copy_only=False).astype(float)
            told = np.flatnonzero(~np.isnan(target))
            w, b = fit([features[i] for i in told], target[told], 1 << bits)
            at = np.flatnonzero(w)
            out.append(pa.table({"family": pa.array([k] * (len(at) + 1), pa.int32()), "at": pa.array([-1, *at.tolist()], pa.int32()), "w": pa.array([b, *w[at].tolist()], pa.float64())}))
        return pa.concat_tables(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    believed = believed.mapInArrow(hashed, f"doc_id {kind}, at array<int>, quality double, civility double").withColumn("all", F.lit(0))
    model = {"bits": bits, "w": np.zeros((1 << bits, len(FAMILIES))), "b": np.zeros(len(FAMILIES))}
    for k, at, w in believed.groupBy("all").applyInArrow(learn, "family int, at int, w double").collect():
        if at < 0:
            model["b"][k] = w
        else:
            model["w"][at, k] = w
    return model


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = 10_000, bits: int = 18, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality, civility, kept) of each row of ``docs`` (doc_id, text).

    quality and civility are probabilities; kept: both reach ``threshold``. ``labels`` (doc_id, quality 0/1, toxic 0/1,
    nulls allowed, of repeated ones the worse) is one labeller more, whose accuracy is estimated like the others'. A null text is scored as an empty one. Repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(train(docs, labels, work_dir(spark), sample, bits))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        maker = Features(model["bits"])
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                z = [model["w"][maker.document(t)].sum(axis=0) + model["b"] for t in part.column(1).to_pylist()]
                p = 1 / (1 + np.exp(-np.clip(np.array(z).reshape(-1, len(FAMILIES)), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["doc_id", *FAMILIES])

    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score, f"doc_id {kind}, quality double, civility double")
    return out.withColumn("kept", (F.col("quality") >= threshold) & (F.col("civility") >= threshold))
