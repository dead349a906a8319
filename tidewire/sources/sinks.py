"""Writers: daily replace, batched append, keyed changes, retention, audit log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidewire.functions.records import log_fingerprint, redact

EMPTY = "array<string>"


def stored_flashpoints(flashpoints: DataFrame, run_id: str, day: str) -> DataFrame:
    """Parent rows: an id of run and flashpoint that a retry repeats, trimmed texts, empty lists for NULL."""
    listed = lambda c: F.coalesce(c, F.array().cast(EMPTY))
    title = F.trim("title")
    return flashpoints.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "flashpoint_id"), 256).alias("id"),
        title.alias("title"),
        F.trim("description").alias("description"),
        listed(F.col("entities")).alias("entities"),
        listed(F.col("domains")).alias("domains"),
        F.lit(run_id).alias("run_id"),
        F.lit(day).cast("date").alias("dt"),
    )


def stored_feeds(feeds: DataFrame, flashpoints: DataFrame, run_id: str, day: str) -> DataFrame:
    """Child rows with the stored id of their flashpoint; children of unknown flashpoints are left out."""
    stored = F.sha2(F.concat_ws("|", F.lit(run_id), "flashpoint_id"), 256)
    keyed = feeds.join(flashpoints.select("flashpoint_id").distinct(), "flashpoint_id", "left_semi")
    return keyed.withColumn("flashpoint_id", stored).select(
        F.sha2(F.concat_ws("|", "flashpoint_id", "url"), 256).alias("id"),
        "flashpoint_id",
        "url",
        "title",
        "seendate",
        "domain",
        "language",
        "sourcecountry",
        "description",
        F.lit(None).cast("string").alias("content"),
        F.lit(day).cast("date").alias("dt"),
    )


def replace_day(df: DataFrame, path: str, day: str | None = None) -> None:
    """Replace the days present in ``df``; other days stay. A retry gives the same table.

    With ``day``, the rows are that day's and its partition is overwritten as a
    whole, so a day without rows is left without rows.
    """
    if day is not None:
        df.drop("dt").write.mode("overwrite").parquet(f"{path.rstrip('/')}/dt={day}")
        return
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )


def append_counted(df: DataFrame, path: str) -> int:
    """Append and return the number of rows written, counted during the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("dt").parquet(path)
    return int(seen.get["n"])


def write_json_per_key(df: DataFrame, path: str, key: str) -> None:
    """One directory of JSON per key value; adaptive execution splits what one key has too much of."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).json(path)


def apply_changes(base: DataFrame, changes: DataFrame, as_of: datetime, key: str = "id") -> DataFrame:
    """Next snapshot of a keyed table.

    ``changes`` has the base columns and ``op`` (upsert or delete), one row per
    key. NULL fields of an upsert keep the stored value; ``updated_at`` is set.
    """
    kept = changes.select("*", F.lit(True).alias("_in"))
    b, c = base.alias("b"), kept.alias("c")
    cols = [
        F.coalesce(F.col(f"c.{n}"), F.col(f"b.{n}")).alias(n)
        for n in base.columns
        if n not in (key, "updated_at")
    ]
    stamp = F.when(F.col("c._in"), F.lit(as_of)).otherwise(F.col("b.updated_at")).alias("updated_at")
    return (
        b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
        .where(~F.coalesce(F.col("c.op") == "delete", F.lit(False)))
        .select(F.coalesce(F.col(f"c.{key}"), F.col(f"b.{key}")).alias(key), *cols, stamp)
        .select(*base.columns)
    )


def change_results(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """(key, op, matched): whether a stored row had the key."""
    known = base.select(key).distinct().withColumn("_known", F.lit(True))
    return changes.join(known, key, "left").select(
        key, "op", F.coalesce("_known", F.lit(False)).alias("matched")
    )


# Days kept per kind; articles are kept twice as long as logs.
RETENTION_DAYS = {"log": 30, "article": 60}


def _expired(as_of: datetime, days: Mapping[str, int]) -> Column:
    age = F.lit(False)
    for kind, n in days.items():
        limit = F.lit(as_of) - F.make_dt_interval(F.lit(n))
        age = age | ((F.col("kind") == kind) & (F.col("created_at") < limit))
    return age


def retained(rows: DataFrame, as_of: datetime, days: Mapping[str, int] = RETENTION_DAYS) -> DataFrame:
    return rows.where(~F.coalesce(_expired(as_of, days), F.lit(False)))


def removed_counts(rows: DataFrame, as_of: datetime, days: Mapping[str, int] = RETENTION_DAYS) -> DataFrame:
    return rows.groupBy("kind").agg(
        F.count_if(F.coalesce(_expired(as_of, days), F.lit(False))).alias("removed"),
        F.count("*").alias("total"),
    )


def audit_rows(actions: DataFrame, ts: str = "ts", keep: Sequence[str] = ()) -> DataFrame:
    """Audit-log rows: redacted input and output maps, fingerprint, status, time, day."""
    return actions.select(
        *keep,
        "run_id",
        "agent",
        "action",
        "status",
        "execution_time",
        redact(F.col("params"), 100).alias("input"),
        redact(F.col("result"), 200).alias("output"),
        log_fingerprint(F.col("agent"), F.col("action"), F.col("params"), F.col("result")).alias("fingerprint"),
        F.col(ts).alias("created_at"),
        F.to_date(ts).alias("dt"),
    )


def run_summary(actions: DataFrame, run: str = "run_id") -> DataFrame:
    return actions.groupBy(run).agg(
        F.count("*").alias("actions"),
        F.count_if(F.col("status") != "success").alias("failed"),
        F.sum("execution_time").alias("total_time"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
    )
