"""Recent-context reads over stored hotspots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidewire import fixed
from tidewire.operators.filters import recent
from tidewire.operators.limits import daily_trend
from tidewire.operators.stats import entity_counts, themes


def context_summary(
    hotspots: DataFrame, as_of: datetime, days: int = 7, words: Sequence[str] = fixed.THEME_WORDS, limit: int = 100
) -> dict[str, DataFrame]:
    """Count, themes, entities and daily trend of the newest hotspots."""
    rows = recent(hotspots, as_of, days, limit)
    return {
        "total": rows.agg(F.count("*").alias("n")),
        "themes": themes(rows, words),
        "entities": entity_counts(rows),
        "trend": daily_trend(rows),
    }
