"""Time-series features of an entity: attention, adjusted prices, liquidity, volatility, drawdown, beta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import ratio, rolling, trailing


def attention(weekly: DataFrame) -> DataFrame:
    """Trailing 52-week mean, deviation and count of svi, shock and z; no value sees a later week."""
    w = trailing(52, order="start")
    df = weekly.withColumns({
        "ma52": rolling(F.avg("svi"), w, 26, F.col("svi")),
        "std52": rolling(F.stddev_samp("svi"), w, 26, F.col("svi")),
        "window_n": rolling(F.count("svi"), w, 26),
    })
    return df.withColumns({"shock": ratio(F.col("svi"), F.col("ma52")) - 1, "z": ratio(F.col("svi") - F.col("ma52"), F.col("std52"))})


def adjusted(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """Adds ``adj``: close times after / before of every action with a later ex-date.

    Actions join the days they fall on as a product of their factors, and one window from the last day on multiplies them up; an
    action on a day without a price falls on the next day that has one, whose earlier days it adjusts all the same.
    """
    good = actions.filter((F.col("before_price") > 0) & (F.col("after_price") > 0))
    factors = good.groupBy("entity", F.col("ex_date").alias("date")).agg(F.product(F.col("after_price") / F.col("before_price")).alias("factor"))
    line = prices.withColumn("__price", F.lit(True)).join(factors, ["entity", "date"], "full")
    later = Window.partitionBy("entity").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    line = line.withColumn("adj", F.col("close") * F.coalesce(F.product("factor").over(later), F.lit(1.0)))
    return line.filter("__price").drop("__price", "factor")


def price_features(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Rolling features of (entity, date, adj, volume, cents) with the market's returns (date, close)."""
    mw = Window.partitionBy("entity").orderBy("date")
    mkt = market.select("date", (ratio(F.col("close"), F.lag("close").over(mw)) - 1).alias("mkt"))
    filled = F.last("adj", True).over(mw.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = prices.withColumn("filled", filled).withColumn("ret", ratio(F.col("filled"), F.lag("filled").over(Window.partitionBy("entity").orderBy("date"))) - 1)
    df = df.join(mkt, "date", "left")
    w20, w60, w130 = trailing(20), trailing(60), trailing(130)
    both = F.when(F.col("ret").isNotNull() & F.col("mkt").isNotNull(), F.lit(1))
    df = df.withColumns({
        "vol_ma20": rolling(F.avg("volume"), w20, 10, F.col("volume")),
        "vol_ma60": rolling(F.avg("volume"), w60, 30, F.col("volume")),
        "turnover_ma20": rolling(F.sum("cents"), w20, 10, F.col("cents")) / (F.count("cents").over(w20) * 100.0),
        "volatility_20": rolling(F.stddev_samp("ret"), w20, 10, F.col("ret")),
        "volatility_60": rolling(F.stddev_samp("ret"), w60, 30, F.col("ret")),
        "drawdown": ratio(F.col("adj"), rolling(F.max("adj"), w60, 30, F.col("adj"))) - 1,
        "cov": rolling(F.covar_samp("ret", "mkt"), w130, 65, both),
        "var": rolling(F.var_samp("mkt"), w130, 65, F.col("mkt")),
    })
    df = df.withColumn("beta", ratio(F.col("cov"), F.col("var")))
    return df.withColumn("max_drawdown", rolling(F.min("drawdown"), w60, 30, F.col("drawdown"))).drop("filled", "cov", "var")
