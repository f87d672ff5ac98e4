"""Institutional flows: long to wide, rolling sums, and their as-of join to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.expressions import ratio, rolling, trailing

from . import asof

NAMES = ("foreign", "trust", "dealer")
NETS = (*NAMES, "total")


def pivoted(facts: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(entity, date, {name}_net..., total_net): net of each investor class, 0 where a class has no row."""
    net = F.col("buy") - F.col("sell")
    cols = [F.sum(F.when(F.col("name") == n, net).otherwise(0.0)).alias(f"{n}_net") for n in names]
    return facts.groupBy("entity", "date").agg(*cols, F.sum(net).alias("total_net"))


def net_only(facts: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The layout without classes (entity, date, total_net): classes are null."""
    return facts.select("entity", "date", *[F.lit(None).cast("double").alias(f"{n}_net") for n in names], "total_net")


def rolled(flows: DataFrame, volume: DataFrame) -> DataFrame:
    """Sums over 5 and 20 flow days, with the volume (entity, date, volume) of the same days."""
    df = flows.join(volume.select("entity", "date", "volume"), ["entity", "date"], "left")
    cols = {}
    for c in [*[f"{n}_net" for n in NETS], "volume"]:
        cols[f"{c}_1w"] = rolling(F.sum(c), trailing(5), 3, F.col(c))
        cols[f"{c}_4w"] = rolling(F.sum(c), trailing(20), 10, F.col(c))
    return df.withColumns(cols)


def panel_flows(panel: DataFrame, rolled_: DataFrame, flow_prices: DataFrame, raw_prices: DataFrame) -> DataFrame:
    """The panel with each week's flows (``flow_prices``: days with flows; ``raw_prices``: raw closes) as of its feature date: sums, shares of volume, and value at the raw close."""
    keys = panel.select("entity", "week", "feature_date")
    keys = asof.snap(keys, flow_prices, "entity", F.col("feature_date"), flow_date="at_or_before")
    keys = asof.snap(keys, raw_prices, "entity", F.col("feature_date"), px="price_before")
    got = keys.join(rolled_.withColumnRenamed("date", "flow_date"), ["entity", "flow_date"])
    out = ["entity", "week"]
    for n in NETS:
        out += [F.col(f"{n}_net_1w").alias(f"{n}_value_1w"), F.col(f"{n}_net_4w").alias(f"{n}_value_4w"), ratio(F.col(f"{n}_net_1w"), F.col("volume_1w")).alias(f"{n}_ratio_1w"), ratio(F.col(f"{n}_net_4w"), F.col("volume_4w")).alias(f"{n}_ratio_4w"), (F.col(f"{n}_net_4w") * F.col("px")).alias(f"{n}_money_4w")]
    return panel.join(got.select(*out), ["entity", "week"], "left")


def coverage(panel4: DataFrame, flows: DataFrame) -> DataFrame:
    """Per entity: usable weeks, share of weeks without a ratio, first and last flow day, number of days."""
    weeks = panel4.groupBy("entity").agg(F.count("total_ratio_4w").alias("usable_weeks"), F.count(F.lit(1)).alias("weeks"))
    days = flows.groupBy("entity").agg(F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.count(F.lit(1)).alias("n_days"))
    return days.join(weeks, "entity", "left").withColumn("missing_rate", 1 - F.col("usable_weeks") / F.col("weeks"))
