"""Connected components of an edge table by repeated label exchange, with stored tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    Each round gives a node the smallest label among its own and its neighbours' and then its label's label, so that
    long chains halve. Rounds end when no label changes; labels stay in stored tables, only a count reaches the driver.
    """
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), folder, f"{name}_edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), folder, f"{name}_0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        step = save(labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root")), folder, f"{name}_{k}a")
        hop = step.select(F.col("node").alias("at"), F.col("root").alias("next"))
        fresh = step.join(hop, F.col("root") == F.col("at"), "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        fresh = save(fresh, folder, f"{name}_{k}b")
        if fresh.filter("root <> old").isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")
