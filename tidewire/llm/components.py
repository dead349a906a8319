"""Connected components by contraction; all state is in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.session import cut_lineage


def flatten(hooks: DataFrame) -> DataFrame:
    """(node, up) with up < node or a root: replace up by the root above it, doubling the reach each round."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        jumped = cut_lineage(
            hooks.join(above, "up", "left").select(
                "node", F.coalesce("higher", "up").alias("up"), F.coalesce(F.col("higher") != F.col("up"), F.lit(False)).alias("moved")
            )
        )
        hooks = jumped.select("node", "up")
        if not jumped.where("moved").take(1):
            return hooks


def min_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node of its component.

    Each round every component hooks to its smallest neighbour, the forest of hooks is flattened by
    pointer jumping and the edges are contracted; components at least halve, so rounds grow with the
    logarithm of the nodes. Self loops and repeated edges do not matter; null ends are dropped.
    """
    pairs = edges.where("a is not null and b is not null")
    both = cut_lineage(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).toDF("a", "b").distinct())
    labels = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    live = both.where("a != b")
    while live.take(1):
        hooks = flatten(
            cut_lineage(live.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")))
        )
        to = hooks.select(F.col("node").alias("root"), F.col("up"))
        labels = cut_lineage(labels.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left, right = hooks.toDF("a", "a2"), hooks.toDF("b", "b2")
        live = cut_lineage(live.join(left, "a").join(right, "b").where("a2 != b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
    return labels
