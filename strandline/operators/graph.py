"""Connected components over the cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(by, node, root) for each node of ``edges`` (by, a, b): root is the smallest node reachable in its graph.

    Each round gives a node the smallest label of its own and its neighbours', and then its label's label, so that long
    chains halve. Tables between rounds are stored (``keep``); only whether a label changed reaches the driver.
    """
    both = keep(edges.select(*by, "a", "b").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(*by, F.col("a").alias("node")).agg(F.min("b").alias("low")).select(*by, "node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = keep(labels.join(near, [*by, "node"], "left").select(*by, "node", F.col("root").alias("old"), F.least("root", "low").alias("root")))
        hop = step.select(*by, F.col("node").alias("root"), F.col("root").alias("next"))
        fresh = keep(step.join(hop, [*by, "root"], "left").select(*by, "node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = fresh.select(*by, "node", "root")
        if fresh.filter("root <> old").isEmpty():
            return labels
