"""File sources and sinks: universe, prices, interest series, corporate actions, flows, manifests, result tables.

Schemas are declared, never inferred, so that ids keep leading zeros. A path is a file or a folder of files of one
layout. A file's entity is the last part of its name before the extension (``price_2330.csv``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.asof import assert_contract


def _entity() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"_([^_/]+)\.[a-z]+$", 1)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, a byte-order mark dropped, with the entity of the file."""
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path).withColumn("entity", _entity())


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def require(spark: SparkSession, path: str, what: str) -> str:
    """The path itself; a missing input is an error before any work."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} is missing: {path}")
    return path


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(stock_id, stock_name, keyword, industry, note), all text."""
    return spark.read.option("header", True).schema("stock_id string, stock_name string, keyword string, industry string, note string").csv(require(spark, path, "universe"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(entity, date, close, volume, money); of several rows of a day the last stands, by file name and place in the file."""
    raw = _csv(spark, require(spark, path, "prices"))
    if missing := {"date", "close"} - set(raw.columns):
        raise ValueError(f"price columns are missing: {sorted(missing)}")
    number = lambda c: (F.col(c) if c in raw.columns else F.lit(None)).cast("double")
    df = raw.select("entity", F.to_date("date").alias("date"), number("close").alias("close"), number("Trading_Volume").alias("volume"), number("Trading_money").alias("money"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("__at"))
    last = F.row_number().over(Window.partitionBy("entity", "date").orderBy(F.desc("__at")))
    return df.withColumn("__n", last).filter("__n = 1").drop("__n", "__at")


def read_interest(spark: SparkSession, path: str) -> DataFrame:
    """(entity, start, svi) from any of three layouts: annotated, (date, SVI), or an index and one value column."""
    raw = _csv(spark, require(spark, path, "interest series"))
    names = [c for c in raw.columns if c not in ("entity", "isPartial")]
    partial = F.coalesce(F.lower("isPartial") == "true", F.lit(False)) if "isPartial" in raw.columns else F.lit(False)
    start = next((c for c in ("observation_period_start", "date") if c in names), names[0])
    value = "SVI" if "SVI" in names else next(c for c in names if c != start)
    return raw.filter(~partial).select("entity", F.to_date(F.col(f"`{start}`")).alias("start"), F.col(f"`{value}`").cast("double").alias("svi"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """(entity, ex_date, before_price, after_price); no file, an empty one or one without dates means no actions."""
    kind = "entity string, ex_date date, before_price double, after_price double"
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    try:
        raw = _csv(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], kind)
    if "date" not in raw.columns:
        return spark.createDataFrame([], kind)
    return raw.select("entity", F.to_date("date").alias("ex_date"), F.col("before_price").cast("double"), F.col("after_price").cast("double")).dropna()


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """(entity, date, name, buy, sell) of the broken-down layout, or (entity, date, total_net) of the net-only one."""
    raw = _csv(spark, require(spark, path, "flows"))
    if "institutional_net_shares" in raw.columns:
        return raw.select("entity", F.to_date("date").alias("date"), F.col("institutional_net_shares").cast("double").alias("total_net"))
    return raw.select("entity", F.to_date("date").alias("date"), "name", F.col("buy").cast("double"), F.col("sell").cast("double"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(entity, ...) of a JSON manifest of entries by entity: one document, or a line for each entry."""
    entry = "struct<path:string,scale_factor:double,timeframe:string,geo:string,request_sha256:string,file_sha256:string,error:string>"
    lines = not path.endswith(".json")  # a single document may be spread over lines
    raw = spark.read.option("multiLine", not lines).schema(f"entries map<string,{entry}>").json(require(spark, path, "manifest"))
    return raw.select(F.explode("entries").alias("entity", "e")).select("entity", "e.*")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON line for each entity's entry, so that no task holds all of them; read_manifest reads them."""
    fields = [c for c in manifest.columns if c != "entity"]
    entries = F.create_map(F.col("entity"), F.struct(*fields))
    manifest.select(entries.alias("entries")).write.mode("overwrite").json(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel; rows that break the look-ahead contract stop the job that reads them."""
    return assert_contract(spark.read.parquet(require(spark, path, "panel")))


def safe_name(path: str) -> str:
    """The path under which a table made by the as-of contract is stored, beside the one that it supersedes."""
    return path.rstrip("/") if path.rstrip("/").endswith("_asof_safe") else path.rstrip("/") + "_asof_safe"


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """A result table as Parquet, and on wish as CSV with a header beside it."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(path.rstrip("/") + "_csv")


def write_series(df: DataFrame, path: str) -> None:
    """A series table in one folder for each entity."""
    df.repartition("entity").sortWithinPartitions("entity").write.mode("overwrite").partitionBy("entity").parquet(path)
