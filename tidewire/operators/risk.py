"""Risk rules, summary and chart tables of a report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewire import fixed
from tidewire.functions.text import contains_any, joined_keywords, str_array
from tidewire.operators.trends import correlation_measures, country_risk, risk_score, share, sizes, top_values
from tidewire.session import cut_lineage

# Advice per risk type.
ADVICE = {
    "sentiment_risk": (
        "Monitor sentiment trends closely",
        "Investigate sources of negative sentiment",
        "Prepare response strategies",
    ),
    "temporal_risk": (
        "Monitor for escalation patterns",
        "Prepare rapid response protocols",
        "Increase monitoring frequency",
    ),
    "content_risk": (
        "Review high-risk content immediately",
        "Assess potential escalation scenarios",
        "Prepare crisis communication protocols",
    ),
}


def _row(kind: str, level: Column, confidence: Column, impact: float, factor: Column, advice: Column) -> list:
    return [
        F.lit(kind).alias("risk_type"),
        level.alias("risk_level"),
        confidence.alias("confidence"),
        F.array(factor).alias("factors"),
        F.lit(impact).alias("impact_score"),
        confidence.alias("probability_score"),
        advice.alias("recommendations"),
    ]


def _sentiment_measures() -> list[Column]:
    return [share(F.col("sentiment") < -0.3).alias("negative_share")]


def _sentiment_rows(measured: DataFrame) -> DataFrame:
    r = F.col("negative_share")
    return measured.where(r > 0.3).select(
        *_row(
            "sentiment_risk",
            F.when(r > 0.5, "high").otherwise("medium"),
            r,
            0.7,
            F.format_string(fixed.NEGATIVE_SENTENCE, r),
            str_array(ADVICE["sentiment_risk"]),
        )
    )


def sentiment_risk(articles: DataFrame) -> DataFrame:
    return _sentiment_rows(articles.agg(*_sentiment_measures()))


def _geographic_rows(scores: DataFrame, threshold: float) -> DataFrame:
    s, c = F.col("risk_score"), F.col("country")
    return (
        scores.where(s > threshold)
        .orderBy(F.desc("risk_score"), "country")
        .limit(1)
        .select(
            *_row(
                "geographic_risk",
                F.when(s > 0.8, "high").otherwise("medium"),
                s,
                0.8,
                F.format_string(fixed.COUNTRY_RISK_SENTENCE, c, s),
                F.array(
                    F.concat(F.lit("Focus monitoring on "), c),
                    F.lit("Analyze regional implications"),
                    F.lit("Coordinate with regional experts"),
                ),
            )
        )
    )


def geographic_risk(articles: DataFrame, threshold: float = 0.6, **kw) -> DataFrame:
    return _geographic_rows(country_risk(articles, **kw), threshold)


def _temporal_measures(fresh: Column) -> list[Column]:
    return [
        F.count("*").alias("article_count"),
        F.count_if(fresh).alias("fresh_count"),
        F.avg(F.when(fresh, F.col("sentiment"))).alias("fresh_mood"),
    ]


def _fresh(as_of: datetime, hours: int) -> Column:
    return F.col("published_at") >= F.lit(as_of - timedelta(hours=hours))


def _temporal_rows(measured: DataFrame, share_: float, floor: float) -> DataFrame:
    n = F.col("article_count")
    return measured.where((n >= 5) & (F.col("fresh_count") > n * share_) & (F.col("fresh_mood") < floor)).select(
        *_row(
            "temporal_risk",
            F.lit("medium"),
            F.lit(0.6),
            0.6,
            F.lit("High recent activity with negative sentiment"),
            str_array(ADVICE["temporal_risk"]),
        )
    )


def temporal_risk(
    articles: DataFrame, as_of: datetime, hours: int = 24, share: float = 0.5, floor: float = -0.2
) -> DataFrame:
    return _temporal_rows(articles.agg(*_temporal_measures(_fresh(as_of, hours))), share, floor)


def _content_measures(urgent: Column) -> list[Column]:
    hit = (F.col("relevance") > 0.8) & urgent
    return [share(hit).alias("urgent_share"), F.count_if(hit).alias("urgent_count")]


def _content_rows(measured: DataFrame) -> DataFrame:
    r, n = F.col("urgent_share"), F.col("urgent_count")
    return measured.where(n > 0).select(
        *_row(
            "content_risk",
            F.when(r > 0.1, "high").otherwise("medium"),
            r,
            0.8,
            F.format_string("High-risk content detected: %d articles", n),
            str_array(ADVICE["content_risk"]),
        )
    )


def content_risk(articles: DataFrame, words: Sequence[str] = fixed.URGENT_WORDS) -> DataFrame:
    return _content_rows(articles.agg(*_content_measures(contains_any(joined_keywords(F.col("keywords")), words))))


class Overview:
    """Everything a report says of all articles and of each country, from one pass over the articles.

    Words are looked for once per article; what goes on are a few numbers and flags, which are rolled up to
    countries and to all articles in one aggregation that combines before its shuffle. Its result, one row per
    country and one for all, is written once, and the parts are picked from it.
    """

    def __init__(
        self,
        articles: DataFrame,
        as_of: datetime,
        conflict_words: Sequence[str] = fixed.CONFLICT_WORDS,
        urgent_words: Sequence[str] = fixed.URGENT_WORDS,
        hours: int = 24,
    ) -> None:
        words = joined_keywords(F.col("keywords"))
        marked = articles.select(
            "country",
            "sentiment",
            "relevance",
            "quality",
            *sizes(),
            _fresh(as_of, hours).alias("fresh"),
            contains_any(words, conflict_words).alias("conflict"),
            contains_any(words, urgent_words).alias("urgent"),
        )
        measures = [
            *_sentiment_measures(),
            *_temporal_measures(F.col("fresh")),
            *_content_measures(F.col("urgent")),
            risk_score(F.col("conflict")).alias("risk_score"),
            *[F.avg(c).alias(f"avg_{c}") for c in ("sentiment", "relevance", "quality")],
            F.min("sentiment").alias("lo"),
            F.max("sentiment").alias("hi"),
            *correlation_measures(),
        ]
        self._rows = cut_lineage(marked.rollup("country").agg(F.grouping("country").alias("overall"), *measures))

    def totals(self) -> DataFrame:
        """The row of all articles; counts are zero where there are none."""
        names = [c for c in self._rows.columns if c not in ("country", "overall")]
        whole = self._rows.where("overall = 1").agg(*[F.max(c).alias(c) for c in names])
        return whole.fillna(0, [c for c in names if c.endswith("_count") or c == "sample_size"])

    def country_risk(self, min_articles: int = 3) -> DataFrame:
        """The rows of :func:`tidewire.operators.trends.country_risk`."""
        named = self._rows.where("overall = 0 and country is not null and country <> ''")
        return named.where(F.col("article_count") >= min_articles).select(
            "country", "article_count", F.coalesce("avg_sentiment", F.lit(0.0)).alias("avg_sentiment"), "risk_score"
        )

    def risks(self) -> DataFrame:
        totals = self.totals()
        return (
            _sentiment_rows(totals)
            .unionByName(_geographic_rows(self.country_risk(), 0.6))
            .unionByName(_temporal_rows(totals, 0.5, -0.2))
            .unionByName(_content_rows(totals))
        )


def all_risks(
    articles: DataFrame,
    as_of: datetime,
    conflict_words: Sequence[str] = fixed.CONFLICT_WORDS,
    urgent_words: Sequence[str] = fixed.URGENT_WORDS,
) -> DataFrame:
    return Overview(articles, as_of, conflict_words, urgent_words).risks()


def summary(
    articles: DataFrame,
    trends: DataFrame,
    countries: DataFrame,
    risks: DataFrame,
    period_days: int = 7,
    totals: DataFrame | None = None,
) -> DataFrame:
    """One row of totals, means, top categories and counts of the other outputs.

    ``totals`` are those of an :class:`Overview` where there is one.
    """
    means = [f"avg_{c}" for c in ("sentiment", "relevance", "quality")]
    if totals is None:
        totals = articles.agg(F.count("*").alias("article_count"), *[F.avg(m[4:]).alias(m) for m in means])
    cats = top_values(articles, F.col("categories"), 5, "category").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category"))),
            lambda s: s["category"],
        )
    )
    return totals.select(F.col("article_count").alias("total_articles"), *means).withColumns(
        {
            "top_categories": cats.scalar(),
            "trends_count": trends.agg(F.count("*")).scalar(),
            "countries_analyzed": countries.agg(F.count("*")).scalar(),
            "high_risks": risks.agg(
                F.count_if(F.col("risk_level").isin("high", "critical"))
            ).scalar(),
            "medium_risks": risks.agg(F.count_if(F.col("risk_level") == "medium")).scalar(),
            "analysis_period": F.lit(f"{period_days} days"),
        }
    )
