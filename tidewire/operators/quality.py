"""Rule, schema and consistency checks; output monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions import urls
from tidewire.functions.records import policy, rule_errors
from tidewire.functions.scores import filled
from tidewire.operators.dedup import duplicate_urls
from tidewire.operators.resolve import missing_articles


def hotspot_errors() -> Column:
    conf = F.col("confidence_score")
    bad_url = F.exists("article_urls", lambda u: ~(urls.is_http(u) & urls.well_formed(u)))
    return rule_errors(
        (~conf.between(0.0, 1.0), "confidence_score: must be between 0.0 and 1.0"),
        (F.size("article_urls") < 1, "article_urls: at least one article URL is required"),
        (bad_url, "article_urls: invalid URL"),
    )


def article_errors() -> Column:
    return rule_errors(
        (F.length(F.trim("title")) < 5, "title: must be at least 5 characters long"),
        (F.length(F.trim("content")) < 10, "content: must be at least 10 characters long"),
        (~(urls.is_http(F.col("url")) & urls.well_formed(F.col("url"))), "url: invalid URL"),
    )


def flashpoint_errors() -> Column:
    blank_domain = F.coalesce(F.exists("domains", lambda d: F.trim(d) == ""), F.lit(False))
    return rule_errors(
        (F.trim("title") == "", "title: cannot be empty"),
        (F.trim("description") == "", "description: cannot be empty"),
        (F.size("entities") < 1, "entities: cannot be empty"),
        (blank_domain, "domains: cannot be blank"),
    )


def validation_report(df: DataFrame, errors: Column) -> DataFrame:
    """(valid, n) counts of a rule list."""
    return df.select((F.size(errors) == 0).alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))


def invalid_rows(df: DataFrame, errors: Column, key: str = "id") -> DataFrame:
    return df.select(key, errors.alias("errors")).where(F.size("errors") > 0)


def business_rules(hotspots: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """(rule, id, message) violations.

    One row per offending hotspot or url, so that no list grows with the data.
    """
    hid = F.col("id").cast("string").alias("id")

    def violation(rule: str, rows: DataFrame, key: Column, message: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), key.alias("id"), message.alias("message"))

    empty = violation(
        "no_empty_hotspots",
        hotspots.where(F.coalesce(F.size("article_urls"), F.lit(0)) < 1),
        hid,
        F.lit("Hotspot has no associated articles"),
    )
    twice = violation(
        "no_duplicate_urls", duplicate_urls(hotspots), F.col("url"), F.lit("URL occurs more than once")
    )
    low = violation(
        "minimum_confidence_threshold",
        hotspots.where(F.coalesce("confidence_score", F.lit(0.0)) < min_confidence),
        hid,
        F.lit("Confidence below threshold"),
    )
    stamp = F.col("created_at").cast("string")
    dated = violation(
        "valid_date_format",
        hotspots.where(F.try_to_timestamp(stamp).isNull()),
        hid,
        F.concat(F.lit("Invalid date format: "), F.coalesce(stamp, F.lit(""))),
    )
    return empty.unionByName(twice).unionByName(low).unionByName(dated)


def consistency_issues(hotspots: DataFrame, articles: DataFrame) -> DataFrame:
    """(type, id, detail): missing articles, malformed entities, mixed languages."""
    missing = missing_articles(hotspots, articles).select(
        F.lit("missing_article_urls").alias("type"),
        F.col("id").cast("string").alias("id"),
        F.array_join("missing_urls", ",").alias("detail"),
    )
    text = F.trim("entities_json")
    malformed = hotspots.where(filled(F.col("entities_json")) & ~text.startswith("[")).select(
        F.lit("invalid_entity_format").alias("type"),
        F.col("id").cast("string").alias("id"),
        F.lit("entities are not a list").alias("detail"),
    )
    mixed = (
        articles.agg(F.array_sort(F.collect_set("language")).alias("langs"))
        .where(F.size("langs") > 1)
        .select(
            F.lit("mixed_languages").alias("type"),
            F.lit("").alias("id"),
            F.array_join("langs", ",").alias("detail"),
        )
    )
    return missing.unionByName(malformed).unionByName(mixed)


def output_flags(outputs: DataFrame, max_seconds: float = 300.0) -> DataFrame:
    """(agent, kind, issue, severity) rows of agent outputs.

    Reads ``agent, status, output, execution_time``; ``output`` is the text checked
    against the content policy.
    """
    checked = outputs.withColumn("p", policy(F.col("output")))
    failed = (F.col("status") == "failed") | ~filled(F.col("output")) | F.col("output").isNull()

    def flag(cond: Column, kind: str, issue: str, severity: str) -> Column:
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(F.lit(kind).alias("kind"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity")),
        )

    flags = F.array_compact(
        F.array(
            flag(failed, "quality_issue", "empty_or_failed_output", "high"),
            flag(~F.col("p.valid"), "policy_violation", "forbidden_keywords", "medium"),
            flag(F.size("p.warnings") > 0, "anomaly", "warnings", "low"),
            flag(F.col("execution_time") > max_seconds, "anomaly", "long_execution_time", "medium"),
        )
    )
    return checked.select("agent", F.explode(flags).alias("f")).select("agent", "f.*")


def overall_status(flags: DataFrame) -> DataFrame:
    """One row: the gravest kind of flag, or healthy."""
    kind = F.col("kind")
    rank = F.when(kind == "policy_violation", 3).when(kind == "quality_issue", 2).otherwise(1)
    top = F.max(rank)
    return flags.agg(
        F.when(top == 3, "policy_violation")
        .when(top == 2, "quality_issue")
        .when(top == 1, "anomaly_detected")
        .otherwise("healthy")
        .alias("overall_status")
    )
