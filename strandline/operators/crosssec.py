"""Cross-sectional operators of a week: quantiles, terciles, rank correlation, sort portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import average_rank
from .quantiles import exact_quantiles


def tercile(df: DataFrame, column: str, labels: tuple[str, str, str], out: str, by: str = "week") -> DataFrame:
    """Adds ``out``: right-closed thirds on interpolated quantiles; a week with equal edges has no labels at all."""
    edges = df.groupBy(by).agg(F.percentile(column, F.array(F.lit(0.0), F.lit(1 / 3), F.lit(2 / 3), F.lit(1.0))).alias("__q"))
    q = lambda i: F.col("__q")[i]
    distinct = (q(0) < q(1)) & (q(1) < q(2)) & (q(2) < q(3))
    label = F.when(F.col(column) <= q(1), labels[0]).when(F.col(column) <= q(2), labels[1]).otherwise(labels[2])
    return df.join(edges, by).withColumn(out, F.when(distinct & F.col(column).isNotNull(), label)).drop("__q")


def quantile_flag(df: DataFrame, column: str, q: float, out: str, by: str = "week") -> DataFrame:
    """Adds ``out``: above the week's interpolated quantile (strictly); null values are not."""
    cut = df.groupBy(by).agg(F.percentile(column, q).alias("__cut"))
    return df.join(cut, by).withColumn(out, F.coalesce(F.col(column) > F.col("__cut"), F.lit(False))).drop("__cut")


def sort_portfolio(df: DataFrame, buckets: list[str], values: list[str]) -> DataFrame:
    """Mean, deviation, count and standard error of each value in each observed cell."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count"), (F.stddev_samp(v) / F.sqrt(F.nullif(F.count(v), F.lit(0)))).alias(f"{v}_se")]
    return df.dropna(subset=buckets).groupBy(*buckets).agg(*aggs)


def rank_correlation(df: DataFrame, x: str, y: str, by: str = "week", least: int = 10) -> DataFrame:
    """(by, ic, n): Spearman correlation on the pairs complete in both, for groups of ``least`` pairs or more."""
    pairs = df.select(by, x, y).dropna()
    ranked = pairs.select(by, average_rank(x, [by], False).alias("rx"), average_rank(y, [by], False).alias("ry"))
    out = ranked.groupBy(by).agg(F.corr("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.filter((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def winsorized(df: DataFrame, columns: list[str], tail: float) -> DataFrame:
    """Columns clipped at their pooled quantiles ``tail`` and 1 - ``tail``, which are selected over the cluster at once."""
    if not tail:
        return df
    cuts = {c: q for c, q in exact_quantiles(df, columns, [tail, 1 - tail]).items() if q[0] is not None}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))) for c, (low, high) in cuts.items()})


def clustering(events: DataFrame, by: str = "week") -> Column:
    """Number of events in the same week."""
    return F.count(F.lit(1)).over(Window.partitionBy(by))
