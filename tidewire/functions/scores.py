"""Article scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F

from tidewire import fixed
from tidewire.functions.text import contains_any, str_array


def points(*pairs: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds, at most 1."""
    total = F.lit(0.0)
    for cond, value in pairs:
        total = total + F.when(cond, F.lit(value)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def filled(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def quality(
    title: Column,
    description: Column,
    entity_count: Column,
    source: Column,
    published_at: Column,
    as_of: datetime | Column,
    reliable: Sequence[str] = fixed.RELIABLE_SOURCES,
) -> Column:
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = now.cast("double") - published_at.cast("double")
    return points(
        (F.length(title) > 20, 0.2),
        (F.length(description) > 50, 0.2),
        (entity_count > 5, 0.2),
        (contains_any(F.lower(source), reliable), 0.2),
        (age < 24 * 3600, 0.2),
    )


def relevance(
    geographic: Column,
    political: Column,
    categories: Column,
    keywords: Column,
    relevant_categories: Sequence[str] = fixed.RELEVANT_CATEGORIES,
    relevant_keywords: Sequence[str] = fixed.RELEVANT_KEYWORDS,
) -> Column:
    return points(
        (F.size(geographic) > 0, 0.3),
        (F.size(political) > 0, 0.3),
        (F.arrays_overlap(categories, str_array(relevant_categories)), 0.2),
        (F.arrays_overlap(keywords, str_array(relevant_keywords)), 0.2),
    )


def event_relevance(
    title: Column, url: Column, source: Column, published: Column, keywords: Column
) -> Column:
    return points(
        (filled(title), 0.3),
        (filled(url), 0.2),
        (filled(source), 0.2),
        (filled(published), 0.2),
        (filled(keywords), 0.1),
    )
