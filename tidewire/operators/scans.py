"""Ordered computations that never sort one hot key in a single task.

A key is cut into buckets of its order value. Bucket totals (few rows) are
scanned per key, and rows are only compared inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

AGGS = {"min": F.min, "max": F.max, "sum": F.sum}
PAIR = {"min": F.least, "max": F.greatest}


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order).cast("double") / width).cast("long")


def earlier(
    df: DataFrame, keys: Sequence[str], order: str, value: str, how: str, name: str, width: int
) -> DataFrame:
    """Add ``name``: min or max of ``value`` over the rows of the key with a smaller ``order``.

    ``order`` is an integer column and ``width`` a bucket size in its unit. NULL
    when there is no earlier row.
    """
    agg = AGGS[how]
    cut = df.withColumn("_b", _bucket(order, width))
    per = cut.groupBy(*keys, "_b").agg(agg(value).alias("_v"))
    carried = per.withColumn(
        "_carry",
        agg("_v").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)),
    ).drop("_v")
    inner = W.partitionBy(*keys, "_b").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    return (
        cut.withColumn("_in", agg(value).over(inner))
        .join(carried, [*keys, "_b"])
        .withColumn(name, PAIR[how]("_in", "_carry"))
        .drop("_b", "_in", "_carry")
    )


def early_late_means(
    df: DataFrame, key: str, ts: str, value: str, tie: str = "pos", width: int = 3600
) -> DataFrame:
    """Per key: mean of ``value`` over the first half (floor) of rows by time and over the rest.

    Buckets wholly before or after the middle are taken from their totals; only
    the bucket that holds the middle is ranked row by row.
    """
    cut = df.select(key, ts, tie, value).withColumn("_b", _bucket(ts, width))
    per = cut.groupBy(key, "_b").agg(
        F.count("*").alias("n"), F.sum(value).alias("s"), F.count(value).alias("c")
    )
    by_key = W.partitionBy(key)
    upto = by_key.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    placed = per.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(upto), F.lit(0)),
            "half": F.floor(F.sum("n").over(by_key) / 2),
        }
    )
    early = F.col("before") + F.col("n") <= F.col("half")
    late = F.col("before") >= F.col("half")
    whole = placed.where(early | late).select(key, early.alias("early"), "s", "c")
    middle = placed.where(~early & ~late).select(key, "_b", "before", "half")
    rank = F.row_number().over(W.partitionBy(key, "_b").orderBy(ts, tie))
    split = (
        cut.join(middle, [key, "_b"])
        .withColumn("early", F.col("before") + rank <= F.col("half"))
        .groupBy(key, "early")
        .agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    )
    both = whole.unionByName(split)

    def mean(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("c")))

    return both.groupBy(key).agg(
        mean(F.col("early")).alias("early_mean"), mean(~F.col("early")).alias("late_mean")
    )


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """First ``k`` rows per key. The row-number filter is applied before the
    shuffle as well, so each task sends at most ``k`` rows per key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def position(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, name: str = "position", width: int = 3600
) -> DataFrame:
    """Add ``name``: 1-based place of a row inside its key by (order, tie).

    Rows are numbered inside buckets of ``order``; the bucket sizes, summed up
    per key, give the offset.
    """
    cut = df.withColumn("_b", _bucket(order, width))
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .drop("_n")
    )
    inner = W.partitionBy(*keys, "_b").orderBy(order, tie)
    return (
        cut.withColumn("_r", F.row_number().over(inner))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_before") + F.col("_r"))
        .drop("_b", "_r", "_before")
    )


def chunk_number(
    df: DataFrame, keys: Sequence[str], size: int, order: str, tie: str, width: int = 3600
) -> DataFrame:
    """Add ``chunk``: number of the batch of ``size`` rows inside the key."""
    placed = position(df, keys, order, tie, "_place", width)
    return placed.withColumn("chunk", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")
