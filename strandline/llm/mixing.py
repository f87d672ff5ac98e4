"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

DataFrame functions only. Each source's share of the mix is turned into whole blocks of ``block_words`` words:
blocks go to sources, and within a source to its shards, by highest quotients. In each shard the documents stand in a
seeded order, the blocks of that stream are numbered, and the quota takes whole passes over the shard and then its
first blocks.

Scale: one pass over the texts writes (key, source, size); all later work is on these few bytes a document. A hot
source is split into shards of about ``shard_words`` words, so no task holds a whole source. Source and shard tables
have one row for each source or ``shard_words`` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, WHITE, row_key, save, unwrapped, whole, word_count, work_dir

#: Weights of sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Shards that share their quota in one window.
HERD = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``total`` times all words shared by weight, no target above ``cap`` times its source.

    Sources stand in code-point order, null last. What exceeds a cap is reshared by weight among the others until none
    is above; with sources sorted by cap over weight that fixpoint is the first level that its own cap does not stop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = per.withColumn("w", weight).withColumn("c", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * total - (F.sum("c").over(by) - F.col("c"))) / (F.sum("w").over(every) - F.sum("w").over(by) + F.col("w"))
    ranked = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("c") / F.col("w"), F.struct((F.col("c") / F.col("w")).alias("r"), "level"))).over(every)["level"]
    return ranked.select("source", "source_size", F.least(F.col("c"), F.coalesce(first, F.lit(0.0)) * F.col("w")).alias("target"))


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the seats of each row when each group's ``seats`` go to the highest quotients weight / (2 k + 1).

    Two divisors that bracket the outcome (their rounded seats sum to no more, and no fewer, than the seats) bound
    each row's seats; only quotients between the two are ranked, about one for each row.
    """
    w = Window.partitionBy(*group)
    kept = df.columns
    sums = df.withColumn("__w", F.sum(weight).over(w)).withColumn("__m", F.count(F.lit(1)).over(w))
    half = F.col("__m") / 2 + 1
    at = lambda n: F.greatest(F.lit(0.0), F.floor(F.col(weight) * n / F.col("__w") + 0.5)).cast("long")
    low = F.when((F.col("__w") > 0) & (F.col(seats) > half), at(F.col(seats) - half)).otherwise(F.lit(0).cast("long"))
    high = F.when(F.col("__w") > 0, at(F.col(seats) + half)).otherwise(F.lit(0).cast("long"))
    sums = sums.withColumn("__low", low).withColumn("__high", high)
    sums = sums.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    tries = sums.withColumn("__k", F.explode(F.expr("sequence(__low, greatest(__high, __low))")))
    quotient = F.when(F.col("__k") < F.col("__high"), F.col(weight) / (2 * F.col("__k") + 1))
    rank = F.row_number().over(w.orderBy(quotient.desc_nulls_last(), *order, "__k"))
    won = tries.withColumn("__won", (quotient.isNotNull() & (rank <= F.col("__left"))).cast("long"))
    return won.groupBy(*kept, "__low").agg(F.sum("__won").alias("__won")).select(*kept, (F.col("__low") + F.col("__won")).alias(out))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_words: int = 250_000, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, key, taken) for each row of ``docs`` (doc_id, text, source).

    A null or empty text has size 0 and takes 0. Null is a source of its own, last in order. Rows equal in doc_id,
    source and size are told apart by position only and take the same words in all. Equal seeds give equal results.
    An empty table gives an empty result. Further columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "source", "text")
    folder = work_dir(docs.sparkSession)
    sizes = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key("doc_id", "source", "text").alias("key")), folder, "sizes")
    targets = source_targets(sizes, weights, total, cap)
    blocks = targets.withColumn("__all", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    quotas = apportion(blocks, ["__all"], "target", "__all", [F.col("source").asc_nulls_last()], "quota").drop("__all")
    quotas = quotas.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    quotas = save(quotas.coalesce(1), folder, "quotas").withColumnRenamed("source", "of")
    mark = F.xxhash64(F.lit(seed), F.col("key"))
    dealt = sizes.join(quotas.select("of", "shards"), F.col("source").eqNullSafe(F.col("of"))).withColumn("mark", mark)
    dealt = dealt.select("doc_id", "source", "size", "key", "mark", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.col("shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = shards.join(quotas, F.col("source").eqNullSafe(F.col("of"))).drop("of", "shards")
    # In two levels, first to groups of shards: no window holds all shards of a hot source.
    shards = shards.withColumn("herd", F.floor(F.col("shard") / HERD))
    herds = shards.groupBy("source", "herd").agg(F.sum("words").alias("words"), F.first("quota").alias("quota"))
    herds = apportion(herds, ["source"], "words", "quota", [F.col("herd")], "blocks")
    herds = herds.select(F.col("source").alias("of"), F.col("herd").alias("in_herd"), F.col("blocks").alias("herd_quota"))
    shards = shards.join(herds, F.col("source").eqNullSafe(F.col("of")) & (F.col("herd") == F.col("in_herd"))).drop("of", "in_herd")
    shards = apportion(shards, ["source", "herd"], "words", "herd_quota", [F.col("shard")], "blocks")
    n = F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long")
    shards = shards.withColumn("n", n).withColumn("blocks", F.least(F.col("blocks"), (F.col("n") * F.floor(F.lit(cap))).cast("long")))
    shards = shards.select(F.col("source").alias("of"), F.col("shard").alias("in_shard"), "source_size", "target", F.floor(F.col("blocks") / F.col("n")).cast("long").alias("passes"), ((F.col("blocks") % F.col("n")) * block_words).alias("rest"))
    shards = save(shards, folder, "shards")
    upto = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("mark", "key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("upto", upto)
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("in_shard")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    return placed.select("doc_id", "size", "source", "source_size", "target", "key", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of ``docs`` as the mix holds them: each as many times as it is taken whole, then its first words.

    ``docs`` has doc_id, text, source and any others, which stay under any name; ``n_chars``, if there, is set to the
    length of what is taken. A row of which nothing is taken is left out, save those without any word, which no target
    counts. Words of a partly taken row are joined by one space. Rows equal in doc_id, source and text are numbered, and
    each gets the taken words of its number.
    """
    keyed = docs.select(whole(docs, "text"), "text", row_key("doc_id", "source", "text").alias("key"))
    alike = Window.partitionBy("key")
    keyed = keyed.withColumn("n", F.row_number().over(alike.orderBy(F.xxhash64("row"))))
    taken = mix(docs, **how).select("key", "size", "taken")
    taken = taken.select(F.col("key").alias("of"), "size", "taken", F.row_number().over(alike.orderBy(F.desc("taken"))).alias("place"))
    joined = keyed.join(taken.hint("merge"), (F.col("key") == F.col("of")) & (F.col("n") == F.col("place")))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = joined.withColumn("copy", F.explode(copies))
    first = F.concat_ws(" ", F.slice(F.split(F.btrim(F.col("text"), F.lit(WHITE)), SEPARATORS), F.lit(1), F.greatest(F.col("copy"), F.lit(1))))
    rows = rows.withColumn("text", F.when(F.col("copy") < 0, F.col("text")).otherwise(first))
    return rows.select(*unwrapped(docs, text=F.col("text"), n_chars=F.length("text").cast("long")))
