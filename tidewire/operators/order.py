"""Ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.session import cut_lineage


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their 1-based ``place`` in the order.

    The rows are sorted by ranges and written once; a place is the row's number
    inside its range plus the sizes of the ranges before, of which there is one
    row each.
    """
    inside = F.monotonically_increasing_id()
    ranges = cut_lineage(df.orderBy(*order).select("*", inside.alias("_n")))
    # The upper bits number the range, the lower 33 the row in it.
    numbered = ranges.select("*", F.shiftright("_n", 33).alias("_range"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("_in"))
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_size"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        numbered.join(offsets, "_range")
        .withColumn("place", F.col("_before") + F.col("_in") + 1)
        .drop("_n", "_range", "_in", "_before")
    )
