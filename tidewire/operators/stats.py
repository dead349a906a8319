"""Counting reports over stored tables, logs, usage and fetch results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewire import fixed
from tidewire.functions.text import needs_translation
from tidewire.operators.filters import item_is_valid
from tidewire.operators.scans import top_k


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def themes(hotspots: DataFrame, words: Sequence[str] = fixed.THEME_WORDS, k: int = 10) -> DataFrame:
    """Hotspots per theme word found in title or summary, one count per hotspot and word."""
    hit = [
        F.when(
            F.contains(F.lower("title"), F.lit(w)) | F.contains(F.lower("summary"), F.lit(w)), F.lit(w)
        )
        for w in words
    ]
    return (
        hotspots.select(F.explode(F.array_compact(F.array(*hit))).alias("theme"))
        .groupBy("theme")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "theme")
        .limit(k)
    )


def entity_counts(hotspots: DataFrame, k: int = 20, col: str = "entities_json") -> DataFrame:
    """Most frequent "name (type)" of JSON entity lists; unreadable lists count as empty."""
    parsed = F.from_json(col, "array<struct<name:string,type:string>>")
    e = F.col("e")
    return (
        hotspots.select(F.explode(parsed).alias("e"))
        .where(F.coalesce(e["name"], F.lit("")) != "")
        .select(F.concat(e["name"], F.lit(" ("), F.coalesce(e["type"], F.lit("unknown")), F.lit(")")).alias("entity"))
        .groupBy("entity")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "entity")
        .limit(k)
    )


def country_distribution(flashpoints: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentions per lower-case country entity; ``resolved(entity, country)``."""
    known = resolved.where("country IS NOT NULL").select("entity").distinct()
    return (
        flashpoints.select(F.explode("entities").alias("entity"))
        .join(known, "entity", "left_semi")
        .groupBy(F.lower("entity").alias("entity"))
        .agg(F.count("*").alias("n"))
    )


def store_stats(tables: dict[str, DataFrame], as_of: datetime, recent: Sequence[str]) -> DataFrame:
    """Rows per table, and rows of the last 24 hours for the tables named in ``recent``."""
    since = F.lit(as_of - timedelta(hours=24))
    out = None
    for name, df in tables.items():
        fresh = F.count_if(F.col("created_at") >= since) if name in recent else F.lit(None).cast("long")
        row = df.agg(F.count("*").alias("total"), fresh.alias("last_24h")).select(
            F.lit(name).alias("table_name"), "total", "last_24h"
        )
        out = row if out is None else out.unionByName(row)
    return out


def day_stats(flashpoints: DataFrame, feeds: DataFrame) -> DataFrame:
    """(kind, key, count): totals, feeds per domain and per language of a day."""

    def total(df: DataFrame, key: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(key).alias("key"), "n")

    def per(col: str) -> DataFrame:
        return (
            feeds.where(F.coalesce(F.col(col), F.lit("")) != "")
            .groupBy(F.col(col).alias("key"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(col).alias("kind"), "key", "n")
        )

    return total(flashpoints, "flashpoints").unionByName(total(feeds, "feeds")).unionByName(
        per("domain")
    ).unionByName(per("language"))


def _log_measures() -> list[Column]:
    ok = F.col("status") == "success"
    return [
        F.count("*").alias("executions"),
        F.count_if(ok).alias("successful"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
        F.coalesce(_share(ok), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("execution_time"), F.lit(0.0)).alias("total_time"),
        F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.max("execution_time"), F.lit(0.0)).alias("max_time"),
    ]


def audit_by_agent(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys, "agent").agg(*_log_measures())


def audit_by_run(logs: DataFrame, run: str = "run_id") -> DataFrame:
    return logs.groupBy(run).agg(*_log_measures())


def session_costs(priced: DataFrame, session: str = "session", ts: str | None = None) -> DataFrame:
    """Totals, means, rates and advice flags per session of priced calls."""
    calls, cost = F.count("*"), F.sum("cost")
    tin, tout = F.sum("input_tokens"), F.sum("output_tokens")
    measures = [
        calls.alias("total_calls"),
        tin.alias("total_input_tokens"),
        tout.alias("total_output_tokens"),
        cost.alias("total_cost"),
        (cost / calls).alias("avg_cost_per_call"),
        ((tin + tout) / calls).alias("avg_tokens_per_call"),
        F.count_if(F.col("cost") > 0.10).alias("high_cost_calls"),
        (cost / calls > 0.05).alias("advise_batching"),
        (tin > tout * 10).alias("advise_shorter_prompts"),
        (cost > 1.0).alias("advise_cheaper_model"),
    ]
    if ts:
        minutes = (F.max(ts).cast("double") - F.min(ts).cast("double")) / 60
        measures.append(F.when(minutes > 0, calls / minutes).otherwise(0.0).alias("calls_per_minute"))
    return priced.groupBy(session).agg(*measures)


def event_confidence(claims: DataFrame, event: str = "event_id") -> DataFrame:
    """round(0.8 * share true + 0.4 * share uncertain, 2)."""
    v = F.col("verdict")
    score = 0.8 * _share(v == "true") + 0.4 * _share(v == "uncertain")
    return claims.groupBy(event).agg(F.count("*").alias("claims"), F.round(score, 2).alias("confidence"))


def merge_quality(items: DataFrame) -> DataFrame:
    """Per type total, valid, invalid; the overall valid share on every row."""
    valid = item_is_valid()
    per = items.groupBy("type").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(valid, F.lit(False))).alias("valid"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"),
    )
    overall = items.agg(F.coalesce(_share(valid), F.lit(0.0))).scalar()
    return per.withColumn("overall_quality", overall)


def merge_issues(items: DataFrame) -> DataFrame:
    """One message per invalid item."""
    title = F.coalesce("title", F.lit("No title"))
    return items.where(~F.coalesce(item_is_valid(), F.lit(False))).select(
        "type", "pos", F.concat(F.lit("Invalid "), "type", F.lit(": "), title).alias("issue")
    )


def stage_metrics(metrics: DataFrame, stage: str = "stage") -> DataFrame:
    return metrics.groupBy(stage).agg(
        F.sum("input_count").alias("total_processed"),
        F.sum("output_count").alias("total_output"),
        F.sum("error_count").alias("total_errors"),
        F.avg(F.coalesce("processing_time", F.lit(0.0))).alias("average_time"),
    )


def language_stats(items: DataFrame, target: str = "en") -> DataFrame:
    lang = F.col("language")
    return items.agg(
        F.count("*").alias("total"),
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.count_if(needs_translation(lang, target)).alias("needs_translation"),
    )


def cluster_digest(rows: DataFrame, cluster: str = "cluster", k: int = 3) -> DataFrame:
    """Cluster size and its first three non-empty titles."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("size"))
    first = top_k(rows.where("title <> ''").select(cluster, "pos", "title"), [cluster], k, F.col("pos"))
    titles = first.groupBy(cluster).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]), "; "
        ).alias("summary")
    )
    return sizes.join(titles, cluster, "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def task_stats(tasks: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        F.coalesce(F.sum("execution_time"), F.lit(0.0)).alias("total_time"),
        F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("average_time"),
        F.count_if(failed).alias("failed_tasks"),
        F.coalesce(_share(~failed), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retry_count"),
    )


def tracker_stats(flashpoints: DataFrame, combo: Column) -> DataFrame:
    """Distinct entities and entity combinations seen."""
    seen = (
        flashpoints.select(F.explode("entities").alias("e"))
        .select(F.lower(F.trim("e")).alias("e"))
        .agg(F.count_distinct("e").alias("n"))
    )
    return flashpoints.agg(
        F.count("*").alias("flashpoints"), F.count_distinct(combo).alias("total_combinations")
    ).withColumn("total_entities", seen.scalar())


def fetch_stats(items: DataFrame, query: str = "query") -> DataFrame:
    valid = F.coalesce(item_is_valid(require_http=True), F.lit(False))
    return items.groupBy(query).agg(
        F.count("*").alias("total"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("invalid"),
    )


def verification_table(
    events: DataFrame, claims: DataFrame, related: DataFrame, contradictions: DataFrame, key: str = "event_id"
) -> DataFrame:
    """Per event: claims, confidence, contradictions, related articles."""
    n_related = related.groupBy(key).agg(F.count("*").alias("related_articles"))
    out = (
        events.select(key)
        .join(event_confidence(claims, key), key, "left")
        .join(contradictions, key, "left")
        .join(n_related, key, "left")
    )
    return out.fillna({"claims": 0, "confidence": 0.0, "contradictions": 0, "related_articles": 0})
