"""Panel facts from the order tables: daily prices, weekly interest, flows and corporate actions of each brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKET = "MARKET"
#: Investor class that each return flag stands for.
INVESTORS = {"A": "foreign", "N": "trust", "R": "dealer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, industry, date, close, volume, money, cents): a price series with holes for each brand."""
    rows = trades(spark, sf_dir).select("entity", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))  # whole cents: sums do not depend on their order
    sums = rows.groupBy("entity", "date").agg(F.sum("l_quantity").alias("volume"), cents.alias("cents")).withColumn("money", F.col("cents") / 100)
    return sums.select("entity", F.substring("entity", 7, 1).alias("industry"), "date", (F.col("money") / F.col("volume")).alias("close"), "volume", "money", "cents")


def market(prices: DataFrame) -> DataFrame:
    """(entity, date, close) of the benchmark: all brands of a day together."""
    sums = prices.groupBy("date").agg(F.sum("cents").alias("c"), F.sum("volume").alias("v"))
    return sums.select(F.lit(MARKET).alias("entity"), "date", (F.col("c") / 100 / F.col("v")).alias("close"))


def weekly_interest(spark: SparkSession, sf_dir: str, of: str = "lines") -> DataFrame:
    """(entity, start, svi): interest in a brand's parts in each week that starts on a Sunday.

    ``of``: order lines or distinct orders by date of order, or lines by date of shipping ("ships").
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    rows = trades(spark, sf_dir).select("entity", "l_orderkey", F.to_date("l_shipdate").alias("shipped"))
    rows = rows.withColumnRenamed("shipped", "day") if of == "ships" else rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.date_sub(F.next_day("day", "SUN"), 7)
    count = F.countDistinct("l_orderkey") if of == "orders" else F.count(F.lit(1))
    return rows.groupBy("entity", start.alias("start")).agg(count.cast("double").alias("svi"))


def dividends(prices: DataFrame) -> DataFrame:
    """(entity, ex_date, before_price, after_price): each brand's first trading day of a year gives up 3 % of the close before."""
    w = Window.partitionBy("entity").orderBy("date")
    rows = prices.select("entity", "date", F.lag("close").over(w).alias("before_price"), F.lag("date").over(w).alias("previous"))
    rows = rows.filter(F.col("before_price").isNotNull() & (F.year("date") != F.year("previous")))
    return rows.select("entity", F.col("date").alias("ex_date"), "before_price", (F.col("before_price") * 0.97).alias("after_price"))


def flow_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, date, name, buy, sell): open lines count as bought, filled ones as sold."""
    name = F.create_map(*[F.lit(x) for pair in INVESTORS.items() for x in pair])[F.col("l_returnflag")]
    side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0))
    rows = trades(spark, sf_dir).select("entity", F.to_date("l_shipdate").alias("date"), name.alias("name"), "l_linestatus", "l_quantity")
    return rows.groupBy("entity", "date", "name").agg(side("O").alias("buy"), side("F").alias("sell"))
