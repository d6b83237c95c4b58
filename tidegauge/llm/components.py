"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``u, v``: the smallest node that it reaches.

    Every round takes the smallest label around a node, by pre-aggregated exchanges, and
    then follows it one step; the state is written after each round, so a lost executor
    costs tasks of that round alone.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = staged(both, "edges")
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("label")
    )
    labels = staged(labels, "labels")
    while True:
        around = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels.node == around.u).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = nearer.join(onward, "label", "left").select(
            "node", "old", F.coalesce(F.least("label", "next"), "label").alias("label")
        )
        moved = staged(moved, "labels")
        if moved.filter("label <> old").limit(1).count() == 0:
            return moved.select("node", "label")
        labels = moved.select("node", "label")
