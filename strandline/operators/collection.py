"""State of a collection: entries by series under one request, kept in versions, and what may be read of them.

A request says what was asked for: time frame, region, and the availability policy under which its values may be used. A
series collected under another policy would look ahead, so an entry counts only under the request it was made for, and a
state under another request, or another version of the layout, is started afresh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .governance import request_hash

#: Version of the layout of a state: a fixed value.
VERSION = 2
#: What a request must hold.
REQUEST = ("timeframe", "geo", "availability_policy")
ENTRY = "entity string, scale_factor double, batch bigint, timeframe string, geo string, availability_policy string, request_sha256 string, date_start date, date_end date, available_at_end date, n_rows bigint, file_sha256 string, raw_file_sha256 string, collected_at bigint, error string"


def _asked(request: dict) -> list[Column]:
    if missing := [k for k in REQUEST if k not in request]:
        raise ValueError(f"a request needs {missing}")
    return [*[F.lit(request[k]).alias(k) for k in REQUEST], F.lit(request_hash(request)).alias("request_sha256")]


def _entries(df: DataFrame) -> DataFrame:
    """Columns of an entry, in order; those that ``df`` lacks are null."""
    kinds = [c.strip().split(" ") for c in ENTRY.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def success_entries(series: DataFrame, files: DataFrame, scales: DataFrame, request: dict, at: int) -> DataFrame:
    """An entry for each collected series that has a file.

    ``series``: annotated weeks (entity, start, period_end, available_at, ...); ``files``: (entity, file_sha256,
    raw_file_sha256); ``scales``: (entity, batch, scale_factor); ``at``: when it was collected, as a growing number.
    """
    got = series.groupBy("entity").agg(F.min("start").alias("date_start"), F.max("period_end").alias("date_end"), F.max("available_at").alias("available_at_end"), F.count(F.lit(1)).alias("n_rows"))
    return _entries(got.join(files, "entity").join(scales, "entity").select("*", *_asked(request), F.lit(at).alias("collected_at"), F.lit("").alias("error")))


def error_entries(failed: DataFrame, request: dict, at: int) -> DataFrame:
    """An entry without scale, rows or file for each failure (entity, batch, error)."""
    return _entries(failed.select("entity", "batch", "error", *_asked(request), F.lit(0).alias("n_rows"), F.lit(at).alias("collected_at")))


def upsert(state: DataFrame, entries: DataFrame) -> DataFrame:
    """``state`` with each series' latest entry by ``collected_at``; of equally late ones a success, then the larger hash."""
    both = state.unionByName(entries)
    last = Window.partitionBy("entity").orderBy(F.desc("collected_at"), (F.col("error") == "").desc_nulls_last(), F.desc_nulls_last("file_sha256"))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def current(state: DataFrame, header: DataFrame, request: dict) -> DataFrame:
    """The entries of ``state``, none if its ``header`` (version, request_sha256) is of another request or version.

    An entry of another request, which an older writer may have left, goes too.
    """
    same = header.filter((F.col("version") == VERSION) & (F.col("request_sha256") == request_hash(request))).select(F.lit(True).alias("__same")).limit(1)
    kept = state.join(F.broadcast(same))  # one row or none
    return kept.filter(F.col("request_sha256") == request_hash(request)).drop("__same")


def errors(found: DataFrame, state: DataFrame, header: DataFrame, request: dict) -> DataFrame:
    """(entity, error): the first thing that forbids to read each found file, null where it may be read.

    ``found``: (entity, file_sha256) of the files that are there; those that the state expects and that are not there
    are listed too. Checked in turn: a state at all, its request and version, an entry, its success, each field that the
    request fixes (all that differ are named), the file, its hash.
    """
    asked = {**{k: request[k] for k in REQUEST}, "request_sha256": request_hash(request)}
    known = state.select(F.col("entity").alias("__of"), F.lit(True).alias("__entry"), "scale_factor", *asked, F.col("file_sha256").alias("__expected"), F.col("error").alias("__error"))
    files = found.select("entity", F.coalesce("file_sha256", F.lit("")).alias("__sha"))
    df = files.join(known, F.col("entity") == F.col("__of"), "full").withColumn("entity", F.coalesce("entity", "__of"))
    head = header.agg(F.count(F.lit(1)).alias("__headers"), F.count_if((F.col("version") == VERSION) & (F.col("request_sha256") == asked["request_sha256"])).alias("__matching"))
    df = df.crossJoin(F.broadcast(head))  # one row
    differ = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in asked.items()]))
    error = (
        F.when(F.col("__headers") == 0, "no manifest")
        .when(F.col("__matching") == 0, "manifest of another request")
        .when(F.col("__entry").isNull(), "no entry")
        .when(F.col("scale_factor").isNull(), F.concat(F.lit("failed: "), F.coalesce(F.nullif("__error", F.lit("")), F.lit("no successful collection recorded"))))
        .when(F.size(differ) > 0, F.concat(F.lit("stale/incompatible: "), F.concat_ws(", ", differ)))
        .when(F.col("__sha").isNull(), "no file")
        .when(~F.coalesce(F.col("__expected") == F.col("__sha"), F.lit(False)), "file hash mismatch")
    )
    return df.select("entity", error.alias("error"))


def assert_readable(found: DataFrame, state: DataFrame, header: DataFrame, request: dict) -> None:
    """Fail with the first of the series that must not be read."""
    bad = errors(found, state, header, request).filter("error is not null").orderBy("entity").limit(3).collect()
    if bad:
        raise ValueError("refusing cached series: " + "; ".join(f"{r['entity']}: {r['error']}" for r in bad))


class Store:
    """Versions of a state below a folder: each is written whole and counts from its success mark on; the last one is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(mark(f"{self.path}/{n}/header/_SUCCESS")))

    def header(self) -> DataFrame:
        """(version, request_sha256) of the last state, or no row."""
        held = self._versions()
        return self.spark.read.schema("version int, request_sha256 string").parquet(f"{self.path}/v={held[-1]}/header") if held else self.spark.createDataFrame([], "version int, request_sha256 string")

    def entries(self, request: dict | None = None) -> DataFrame:
        """The last state's entries; with ``request`` only if the state is of it."""
        held = self._versions()
        state = self.spark.read.schema(ENTRY).parquet(f"{self.path}/v={held[-1]}/entries") if held else self.spark.createDataFrame([], ENTRY)
        return state if request is None else current(state, self.header(), request)

    def add(self, entries: DataFrame, request: dict) -> int:
        """Write a version with ``entries`` put in, afresh if the request has changed; its number."""
        n = max(self._versions(), default=0) + 1
        upsert(self.entries(request), entries).write.mode("overwrite").parquet(f"{self.path}/v={n}/entries")
        head = self.spark.createDataFrame([(VERSION, request_hash(request))], "version int, request_sha256 string")
        head.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={n}/header")  # last: its mark makes the version count
        return n
