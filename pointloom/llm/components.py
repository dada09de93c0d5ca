"""Connected components of a graph given as a table of edges: minimum labels with pointer jumping, in joins and aggregates.

No node's edges meet in one task: neighbours' labels reach a node through a join and a minimum with map-side combine. Each
round is a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of `edges` (a long, b long)."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().toDF("a", "b"), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = written(hooked.join(up, "label", "left").select("node", "old", F.coalesce(F.least("label", "up"), "label").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
