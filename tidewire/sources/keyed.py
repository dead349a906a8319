"""A Parquet table of one row per key, of which a change set rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewire.session import cut_lineage

#: The rows of the touched buckets and the rows of a change set to the new rows of these buckets.
Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """Rows in ``buckets`` by the hash of their keys.

    Change set n writes the buckets it touches below ``v=n`` and then the list of where each bucket lies
    below ``parts/v=n``; readers take the last list, so they see all of a change set or none. A change set that is
    repeated starts from the lists before it and replaces itself. Versions that no list in use names can be
    removed by the folder's own clean-up.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, list(keys), schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def parts(self, before: int | None = None) -> dict[int, int]:
        """Version of each bucket that has rows, as of the last change set, or the last one before a number."""
        try:
            lists = self.spark.read.schema("bucket int, version long, v long").parquet(f"{self.path}/parts")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            lists = lists.where(F.col("v") < before)
        last = lists.agg(F.max("v")).first()[0]
        # One row per bucket; a bucket of -1 marks a list without any.
        return {r.bucket: r.version for r in lists.where(F.col("v") == last).collect() if r.bucket >= 0}

    def _load(self, parts: dict[int, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/v={v}/bucket={b}" for b, v in sorted(parts.items())])

    def read(self) -> DataFrame:
        return self._load(self.parts())

    def change(self, number: int, rows: DataFrame, combine: Combine) -> list[int]:
        """Apply change set ``number``; the buckets it rewrote."""
        changed = cut_lineage(rows.withColumn("bucket", self._bucket()))
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())
        if not touched:
            return []
        parts = self.parts(before=number)
        old = self._load({b: parts[b] for b in touched if b in parts})
        new = combine(old, changed.drop("bucket")).select(*self.schema.names)
        target = f"{self.path}/v={number}"
        new.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = self.spark.read.schema(StructType([*self.schema, *self.spark.range(0).select(F.lit(0).alias("bucket")).schema])).parquet(target)
        left = {r.bucket for r in written.select("bucket").distinct().collect()}
        parts = {b: v for b, v in parts.items() if b not in touched} | dict.fromkeys(left, number)
        listed = self.spark.createDataFrame(sorted(parts.items()) or [(-1, -1)], "bucket int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts/v={number}")
        return touched


def newest(keys: Sequence[str], *order: str) -> Combine:
    """Keep the row of a key that is last by ``order``, wherever it comes from."""

    def combine(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.unionByName(rows)
        rest = [c for c in both.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
        return both.groupBy(*keys).agg(last).select(*keys, "_last.*")

    return combine


def added_up(keys: Sequence[str], sums: Sequence[str], maxima: Sequence[str]) -> Combine:
    """Add counts up and keep maxima."""

    def combine(old: DataFrame, rows: DataFrame) -> DataFrame:
        totals = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
        return old.unionByName(rows).groupBy(*keys).agg(*totals)

    return combine
