"""Event activity per window, the same plan for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of (ts, event_type, value) in tumbling windows.

    On a stream, rows up to ``late`` behind the newest are counted and a window's state goes once it cannot change; on
    a table the watermark has no effect.
    """
    window = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def write_activity(events: DataFrame, path: str, checkpoint: str, **how: str) -> StreamingQuery:
    """Append closed windows of a stream as Parquet, from a checkpoint in a shared folder, for all that is there now."""
    return activity(events, **how).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
