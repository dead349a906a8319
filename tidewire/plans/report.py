"""The full analytics report: one dictionary of DataFrames over one input."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidewire import fixed
from tidewire.operators import risk, trends
from tidewire.session import cut_lineage

#: What the parts read of an article.
COLUMNS = (
    "pos", "country", "published_at", "sentiment", "relevance", "quality", "keywords", "categories", "entities",
)


def report(
    articles: DataFrame, as_of: datetime, period_days: int = 7,
    conflict_words: Sequence[str] = fixed.CONFLICT_WORDS,
    urgent_words: Sequence[str] = fixed.URGENT_WORDS,
) -> dict[str, DataFrame]:
    """Trends, countries, correlations, risks, summary and chart tables.

    The articles are read once: the columns that the parts need, without texts, are written as a step and
    all parts start from it. Risks, means, counts and correlations come from one pass over it
    (:class:`tidewire.operators.risk.Overview`).
    """
    rows = cut_lineage(articles.select(*COLUMNS))
    whole = risk.Overview(rows, as_of, conflict_words, urgent_words)
    # A few rows each, which several parts read.
    topic_trends = cut_lineage(trends.topic_trends(rows, as_of, period_days))
    countries = cut_lineage(trends.country_patterns(rows, scores=whole.country_risk()))
    risks = cut_lineage(whole.risks())
    return {
        "trends": trends.rank_trends(topic_trends),
        "countries": countries.orderBy(*trends.risk_order()),
        "correlations": trends.with_significance(trends.correlation_rows(whole.totals())),
        "risks": risks,
        "summary": risk.summary(rows, topic_trends, countries, risks, period_days, whole.totals()),
        "sentiment_histogram": trends.histogram(rows, "sentiment", bounds=whole.totals().select(F.struct("lo", "hi"))),
        "country_map": countries.select("country", "risk_score"),
        "top_trends": trends.rank_trends(topic_trends).select("topic", "confidence").limit(10),
    }
