"""Data governance: manifests, content hashes, legacy comparison, batches and rescaling."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panel import average_rank


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a folder, read and hashed by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def request_hash(config: dict) -> str:
    """SHA-256 of a request's canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest_errors(manifest: DataFrame, files: DataFrame, request: dict) -> DataFrame:
    """(entity, error): the first thing wrong with each entry, null where it is valid.

    ``manifest``: entity, path, scale_factor, timeframe, geo, request_sha256, file_sha256, error. ``files``: file_hashes.
    """
    held = files.select(F.col("path").alias("__path"), F.col("sha256").alias("__sha"))
    df = manifest.join(held, F.col("path") == F.col("__path"), "left")
    error = (
        F.when(F.col("error").isNotNull(), "collection error")
        .when(F.coalesce(F.col("timeframe") != request["timeframe"], F.lit(True)) | F.coalesce(F.col("geo") != request["geo"], F.lit(True)), "stale/incompatible")
        .when(F.coalesce(F.col("request_sha256") != request_hash(request), F.lit(True)), "request hash differs")
        .when(F.col("__sha").isNull(), "missing file")
        .when(F.coalesce(F.col("file_sha256") != F.col("__sha"), F.lit(True)), "file hash differs")
        .when(F.col("scale_factor").isNull(), "no scale factor")
    )
    return df.select("entity", error.alias("error"))


def compare(legacy: DataFrame, corrected: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, legacy, corrected, status, delta): full outer comparison, every absence named."""
    side = lambda df, name: df.select(*keys, F.lit(True).alias(f"__{name}"), *[(F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(f"{name}_{m}") for m in metrics])
    both = side(legacy, "legacy").join(side(corrected, "corrected"), keys, "full")
    rows = []
    for m in metrics:
        if m not in legacy.columns:
            absent = F.lit("blocked_missing_legacy_metric")
        elif m not in corrected.columns:
            absent = F.lit("blocked_missing_corrected_metric")
        else:
            absent = F.lit("compared")
        # Names of the statuses.
        status = F.when(F.col("__legacy").isNull(), "blocked_missing_legacy_key").when(F.col("__corrected").isNull(), "blocked_missing_corrected_key").otherwise(absent)
        rows.append(F.struct(F.lit(m).alias("metric"), F.col(f"legacy_{m}").alias("legacy"), F.col(f"corrected_{m}").alias("corrected"), status.alias("status")))
    out = both.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    return out.withColumn("delta", F.when(F.col("status") == "compared", F.col("corrected") - F.col("legacy")))


def compare_tables(spark: SparkSession, legacy: DataFrame | None, corrected: DataFrame | None, keys: list[str], metrics: list[str]) -> DataFrame:
    """(status, missing, keys, metric, legacy, corrected, delta) of two result tables, either of which may be absent.

    What stops a comparison is one row each: an absent table, a key column that a side lacks (then nothing is compared),
    a metric column that a side lacks, no metric or no key in common. Common metrics are compared key by key.
    """
    kinds = ", ".join(["status string, missing string", *[f"`{k}` string" for k in keys], "metric string, legacy double, corrected double, delta double"])

    # Names of the statuses, here and in compare.
    def stopped(rows: list[tuple[str, str | None, str | None]]) -> DataFrame:
        return spark.createDataFrame([(status, missing, *[None] * len(keys), metric, None, None, None) for status, missing, metric in rows], kinds)

    if legacy is None or corrected is None:
        return stopped([("blocked_missing_table", "legacy" if legacy is None else "corrected", None)])
    sides = {"legacy": legacy.columns, "corrected": corrected.columns}
    if absent := [(f"blocked_missing_{side}_key", k, None) for side, held in sides.items() for k in keys if k not in held]:
        return stopped(absent)
    absent = [(f"blocked_missing_{side}_metric", m, m) for side, held in sides.items() for m in metrics if m not in held]
    common = [m for m in metrics if all(m in held for held in sides.values())]
    if not common:
        return stopped([*absent, ("blocked_no_common_metrics", None, None)])
    rows = compare(legacy, corrected, keys, common)
    rows = rows.select("status", F.lit(None).cast("string").alias("missing"), *[F.col(k).cast("string").alias(k) for k in keys], "metric", "legacy", "corrected", "delta")
    if legacy.isEmpty() and corrected.isEmpty():
        absent.append(("blocked_no_common_keys", None, None))
    return rows.unionByName(stopped(absent)) if absent else rows


def legacy_provenance(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """What is known of each superseded artifact: presence, content hashes, and whether a corrected one stands beside it.

    ``inventory``: claim_area, legacy, corrected (null: not made again), reason. ``files``: file_hashes.
    """
    side = lambda name: files.select(F.col("path").alias(f"__{name}"), F.col("sha256").alias(f"{name}_sha256"))
    df = inventory.join(side("legacy"), F.col("legacy") == F.col("__legacy"), "left").join(side("corrected"), F.col("corrected") == F.col("__corrected"), "left")
    # Names of the statuses.
    made = F.when(F.col("corrected").isNull(), "not_regenerated").when(F.col("__corrected").isNotNull(), "present").otherwise("missing")
    headline = F.when(F.col("corrected").isNull(), "blocked_not_regenerated").when(F.col("__corrected").isNotNull(), "corrected_counterpart_available").otherwise("blocked_corrected_counterpart_missing")
    return df.select("claim_area", "legacy", F.col("__legacy").isNotNull().alias("legacy_present"), "legacy_sha256", "corrected", made.alias("corrected_status"), "corrected_sha256", "reason", headline.alias("headline_status"))


def assert_inventory_complete(inventory: DataFrame, found: DataFrame) -> None:
    """Fail if some found artifact (name) that is no corrected one is not in the inventory (name)."""
    left = missing_artifacts(found.filter(~F.col("name").contains("_asof_safe")), inventory).orderBy("name").limit(5).collect()
    if left:
        raise ValueError(f"artifacts are missing in the inventory: {[r['name'] for r in left]}")


def missing_artifacts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected names that were not found."""
    return expected.select("name").join(found.select("name"), "name", "left_anti")


def batches(universe: DataFrame, anchor: str, size: int = 4) -> DataFrame:
    """(entity, batch): the universe without its anchor in chunks of ``size``, in order of name."""
    place = F.row_number().over(Window.orderBy("entity")) - 1
    return universe.filter(F.col("entity") != anchor).select("entity", F.floor(place / size).alias("batch"))


def scale(reference_mean: Column, batch_mean: Column) -> Column:
    """Factor that brings a batch's anchor to the reference mean; 1 where the batch's mean is not positive."""
    return F.when(batch_mean > 0, reference_mean / batch_mean).otherwise(F.lit(1.0))


def repeat_stability(readings: dict[str, DataFrame]) -> DataFrame:
    """(first, second, n, r, rho, mean_abs_diff) of each pair of readings (entity, start, svi), on the keys in all of them."""
    names, both = list(readings), None
    for name, df in readings.items():
        df = df.select("entity", "start", F.col("svi").alias(name))
        both = df if both is None else both.join(df, ["entity", "start"])
    both = both.withColumns({f"rank_{n}": average_rank(n, ["entity"], False) for n in names})
    rows = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.corr(a, b).alias("r"), F.corr(f"rank_{a}", f"rank_{b}").alias("rho"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"), F.count(F.lit(1)).alias("n")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return both.groupBy("entity").agg(F.array(*rows).alias("x")).select("entity", F.explode("x").alias("x")).select("entity", "x.*")


def manifest_entries(series: DataFrame, request: dict, least: int = 1) -> DataFrame:
    """Manifest entries (entity, status, n_weeks, first_week, last_week, error, request_sha256) of collected series.

    A series of fewer than ``least`` weeks is an error entry. The request's hash is that of its canonical JSON.
    """
    canonical = F.to_json(F.struct(*[F.lit(request[k]).alias(k) for k in sorted(request)]))
    got = series.groupBy("entity").agg(F.count(F.lit(1)).alias("n_weeks"), F.min("start").alias("first_week"), F.max("start").alias("last_week"))
    short = F.col("n_weeks") < least
    status = F.when(short, "error").otherwise("ok")
    return got.select("entity", status.alias("status"), "n_weeks", "first_week", "last_week", F.when(short, F.lit("series too short")).alias("error"), F.sha2(canonical, 256).alias("request_sha256"))
