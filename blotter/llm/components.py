"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a, b).

    Labels take the minimum of their neighbours' and then their label's label, so they
    travel in jumps that double; each round is written before the next.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "component-edges")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("component"))
    labels = written(labels.withColumnRenamed("a", "node"), "component-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(
            F.min("component").alias("_near")
        )
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("component").alias("_old"),
            F.least("component", F.col("_near")).alias("_new"),
        )
        lower = written(lower, "component-lower")
        jump = lower.select(F.col("node").alias("_at"), F.col("_new").alias("_jump"))
        moved = lower.join(jump, F.col("_new") == F.col("_at"), "left").select(
            "node", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("component")
        )
        moved = written(moved, "component-labels")
        labels = moved.select("node", "component")
        if moved.where("component <> _old").isEmpty():
            return labels
