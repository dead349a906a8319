"""Topics, trends, country patterns, correlations, timelines."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewire import fixed
from tidewire.functions.text import contains_any, joined_keywords
from tidewire.operators.scans import early_late_means, top_k


def top_values(df: DataFrame, values: Column, k: int, name: str = "value") -> DataFrame:
    """Most frequent elements of an array column; ties in alphabetical order."""
    return (
        df.select(F.explode(values).alias(name))
        .groupBy(name)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), name)
        .limit(k)
    )


def topics(articles: DataFrame, k: int = 20) -> DataFrame:
    return top_values(articles, F.col("keywords"), k, "topic")


def _in_period(articles: DataFrame, as_of: datetime, period_days: int) -> DataFrame:
    start = as_of - timedelta(days=period_days)
    return articles.where(F.col("published_at").between(F.lit(start), F.lit(as_of)))


def topic_articles(
    articles: DataFrame, as_of: datetime, period_days: int = 7, max_topics: int = 15
) -> DataFrame:
    """(topic, article) rows of the period whose joined keywords contain the topic.

    The topics (at most 20) reach the rows as one scalar array, so the articles
    are scanned in place: no join and no shuffle.
    """
    names = (
        topics(articles)
        .orderBy(F.desc("n"), "topic")
        .limit(max_topics)
        .agg(F.array_sort(F.collect_list("topic")))
        .scalar()
    )
    joined = joined_keywords(F.col("keywords"))
    hits = F.filter(F.col("_topics"), lambda t: F.contains(F.col("_joined"), F.lower(t)))
    return (
        _in_period(articles, as_of, period_days)
        .withColumns({"_topics": names, "_joined": joined})
        .withColumn("topic", F.explode(hits))
        .drop("_topics", "_joined")
    )


def topic_trends(
    articles: DataFrame,
    as_of: datetime,
    period_days: int = 7,
    max_topics: int = 15,
    min_articles: int = 3,
    min_confidence: float | None = 0.5,
) -> DataFrame:
    """Volume, mean sentiment and confidence per topic.

    ``max_topics=15, min_confidence=0.5`` is the report form, ``10, None`` the
    pipeline form.
    """
    days = (
        _in_period(articles, as_of, period_days)
        .agg(F.count_distinct(F.to_date("published_at")))
        .scalar()
    )
    out = (
        topic_articles(articles, as_of, period_days, max_topics)
        .groupBy("topic")
        .agg(
            F.count("*").alias("article_count"),
            F.coalesce(F.avg("sentiment"), F.lit(0.0)).alias("sentiment_trend"),
        )
        .where(F.col("article_count") >= min_articles)
        .select(
            "topic",
            "article_count",
            (F.col("article_count") / days).alias("volume_trend"),
            "sentiment_trend",
            F.least(F.col("article_count") / 10.0, F.lit(1.0)).alias("confidence"),
        )
    )
    if min_confidence is not None:
        out = out.where(F.col("confidence") > min_confidence)
    return out


def trend_order() -> list[Column]:
    """Strongest trends first."""
    return [F.desc("confidence"), F.desc("volume_trend"), F.col("topic")]


def risk_order() -> list[Column]:
    """Riskiest countries first."""
    return [F.desc("risk_score"), F.col("country")]


def rank_trends(trends: DataFrame) -> DataFrame:
    return trends.orderBy(*trend_order())


def related_topics(topic_rows: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent keywords of a topic's articles, the topic itself left out."""
    counts = (
        topic_rows.select("topic", F.explode("keywords").alias("related"))
        .groupBy("topic", "related")
        .agg(F.count("*").alias("n"))
    )
    return top_k(counts, ["topic"], k, F.desc("n"), F.col("related")).where("related <> topic")


def key_entities(topic_rows: DataFrame, k: int = 5) -> DataFrame:
    counts = (
        topic_rows.select("topic", F.explode("entities.text").alias("entity"))
        .groupBy("topic", "entity")
        .agg(F.count("*").alias("n"))
    )
    return top_k(counts, ["topic"], k, F.desc("n"), F.col("entity"))


def share(cond: Column) -> Column:
    """Aggregate expression: the share of rows for which ``cond`` holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def risk_score(conflict: Column) -> Column:
    """Aggregate expression: weighted shares of negative, relevant and conflict articles."""
    return F.least(
        F.lit(1.0),
        0.4 * share(F.col("sentiment") < -0.2)
        + 0.3 * share(F.col("relevance") > 0.8)
        + 0.3 * share(conflict),
    )


def country_risk_column(conflict_words: Sequence[str] = fixed.CONFLICT_WORDS) -> Column:
    """The risk score of articles with keywords."""
    return risk_score(contains_any(joined_keywords(F.col("keywords")), conflict_words))


def country_risk(articles: DataFrame, min_articles: int = 3, **kw) -> DataFrame:
    return (
        articles.where(F.col("country").isNotNull() & (F.col("country") != ""))
        .groupBy("country")
        .agg(
            F.count("*").alias("article_count"),
            F.coalesce(F.avg("sentiment"), F.lit(0.0)).alias("avg_sentiment"),
            country_risk_column(**kw).alias("risk_score"),
        )
        .where(F.col("article_count") >= min_articles)
    )


def trend_direction(articles: DataFrame, key: str = "country", step: float = 0.1) -> DataFrame:
    """increasing / decreasing / stable from the mean sentiment of the two halves in time."""
    means = early_late_means(articles, key, "published_at", "sentiment")
    diff = F.col("late_mean") - F.col("early_mean")
    return means.select(
        key,
        F.when(diff > step, "increasing")
        .when(diff < -step, "decreasing")
        .otherwise("stable")
        .alias("trend_direction"),
    )


def top_keywords(articles: DataFrame, key: str = "country", k: int = 5) -> DataFrame:
    """(key, key_topics): the k most frequent keywords per key, in order."""
    counts = (
        articles.select(key, F.explode("keywords").alias("keyword"))
        .groupBy(key, "keyword")
        .agg(F.count("*").alias("n"))
    )
    best = top_k(counts, [key], k, F.desc("n"), F.col("keyword"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    return best.groupBy(key).agg(F.transform(ordered, lambda s: s["keyword"]).alias("key_topics"))


def country_patterns(
    articles: DataFrame, min_articles: int = 3, scores: DataFrame | None = None, **kw
) -> DataFrame:
    """Per country: count, sentiment, key topics, risk and direction.

    ``scores`` has the rows of :func:`country_risk` where they are known already.
    """
    located = articles.where(F.col("country").isNotNull() & (F.col("country") != ""))
    if scores is None:
        scores = country_risk(located, min_articles, **kw)
    return (
        scores.join(top_keywords(located), "country", "left")
        .join(trend_direction(located), "country", "left")
        .withColumn("key_topics", F.coalesce("key_topics", F.array().cast("array<string>")))
    )


# The five pairs and the bounds of the labels.
CORRELATION_PAIRS = (
    ("sentiment", "relevance"),
    ("sentiment", "quality"),
    ("relevance", "quality"),
    ("entity_count", "relevance"),
    ("keyword_count", "relevance"),
)


def correlations(articles: DataFrame, min_rows: int = 10) -> DataFrame:
    """Pearson r of the fixed pairs, one row each; no row when there is too little data."""
    counted = articles.select("sentiment", "relevance", "quality", *sizes())
    return correlation_rows(counted.agg(*correlation_measures()), min_rows)


def sizes() -> list[Column]:
    """How many entities and keywords an article has."""
    return [F.size(c).cast("double").alias(f"{n}_count") for c, n in (("entities", "entity"), ("keywords", "keyword"))]


def correlation_measures() -> list[Column]:
    """Aggregate expressions: sample_size and r0 to r4 of the pairs, over rows with a sentiment and a relevance."""
    valid = F.col("sentiment").isNotNull() & (F.col("relevance") > 0)

    def pearson(x: str, y: str) -> Column:
        """NULL without variance; ``corr`` fails on it under ANSI rules."""
        x, y = F.when(valid, F.col(x)), F.when(valid, F.col(y))
        scale = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(scale > 0, F.covar_pop(x, y) / scale)

    return [
        F.count_if(valid).alias("sample_size"),
        *[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(CORRELATION_PAIRS)],
    ]


def correlation_rows(measured: DataFrame, min_rows: int = 10) -> DataFrame:
    """One row per pair from the row of measures."""
    pairs = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(CORRELATION_PAIRS))
    return measured.where(F.col("sample_size") >= min_rows).select(
        "sample_size",
        F.expr(
            f"stack({len(CORRELATION_PAIRS)}, {pairs}) AS (variable1, variable2, coefficient)"
        ),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def pearson_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a Pearson correlation."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    x = df / (df + r * r * df / (1.0 - r * r))
    a, b = df / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) if 0.0 < x < 1.0 else 0.0
    if x in (0.0, 1.0):
        return x
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def with_significance(corr: DataFrame) -> DataFrame:
    """Add p-value, significance and the sentence; at most five rows pass through Python."""

    @F.pandas_udf("double")
    def p_values(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(
            [pearson_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)],
            dtype="float64",
        )

    p, r = F.col("p_value"), F.col("coefficient")
    strength = (
        F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")
    )
    direction = F.when(r > 0, "positive").otherwise("negative")
    sure = F.when(p < 0.05, "significant").otherwise("not significant")
    return corr.withColumn("p_value", p_values("coefficient", "sample_size")).withColumns(
        {
            "significance": F.when(p < 0.01, "high").when(p < 0.05, "medium").otherwise("low"),
            "interpretation": F.format_string(
                fixed.CORRELATION_SENTENCE, strength, direction, r, sure, p
            ),
        }
    )


def histogram(df: DataFrame, col: str, bins: int = 20, bounds: DataFrame | None = None) -> DataFrame:
    """Equal-width bins between the least and the greatest value; the top edge is inclusive.

    ``bounds`` is one row with one struct (lo, hi) where they are known already.
    """
    if bounds is None:
        bounds = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")))
    bounds = bounds.scalar()
    lo, hi = F.col("_edge.lo"), F.col("_edge.hi")
    step = (hi - lo) / bins
    slot = F.when(hi == lo, 0).otherwise(
        F.least(F.floor((F.col(col) - lo) / step), F.lit(bins - 1))
    )
    return (
        df.where(F.col(col).isNotNull())
        .select(col)
        .withColumn("_edge", bounds)
        .select(slot.cast("long").alias("bin"), lo.alias("lo"), step.alias("step"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.first(lo_edge()).alias("bin_start"))
    )


def lo_edge() -> Column:
    return F.col("lo") + F.col("bin") * F.col("step")


TIMELINE_MODES = (
    "timelinevol", "timelinevolraw", "timelinetone", "timelinelang", "timelinesourcecountry",
)


def timeline(
    articles: DataFrame, mode: str, matches: Column, ts: str = "published_at", tone: str = "sentiment"
) -> DataFrame:
    """Daily series (day, series, value, norm) of the matching articles.

    Volume is the share of all articles of the day in percent, raw volume the
    count with the day's total as ``norm``; one row per series and day.
    """
    if mode not in TIMELINE_MODES:
        raise ValueError(f"unknown timeline mode {mode}")
    day = F.to_date(ts).alias("day")
    hit = F.coalesce(matches, F.lit(False))
    if mode in ("timelinevol", "timelinevolraw"):
        base = articles.groupBy(day).agg(
            F.count_if(hit).alias("n"), F.count("*").alias("norm")
        )
        value = F.col("n") * 100.0 / F.col("norm") if mode == "timelinevol" else F.col("n") * 1.0
        name = "Volume Intensity" if mode == "timelinevol" else "Article Count"
        return base.select("day", F.lit(name).alias("series"), value.alias("value"), "norm")
    found = articles.where(hit)
    if mode == "timelinetone":
        return found.groupBy(day).agg(F.avg(tone).alias("value"), F.count("*").alias("norm")).select(
            "day", F.lit("Average Tone").alias("series"), "value", "norm"
        )
    by = "language" if mode == "timelinelang" else "country"
    totals = articles.groupBy(day).agg(F.count("*").alias("norm"))
    return (
        found.groupBy(day, F.col(by).alias("series"))
        .agg(F.count("*").alias("n"))
        .join(totals, "day")
        .select("day", "series", (F.col("n") * 100.0 / F.col("norm")).alias("value"), "norm")
    )


def wide_timeline(series: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One column per series; give ``names`` to spare the pass that finds them."""
    return series.groupBy("day").pivot("series", list(names) if names else None).agg(F.first("value"))
