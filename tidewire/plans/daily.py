"""The daily job: flashpoints to queries, feeds, merged entries and stored days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from tidewire.operators import dedup, expansion, filters
from tidewire.sources import sinks


def expand_queries(queries: DataFrame, languages: DataFrame, translations: DataFrame) -> DataFrame:
    """Query rows times target languages, with texts."""
    return expansion.expand_languages(queries.join(languages, "query_pos"), translations)


def merge_entries(article_lists: DataFrame, feeds: DataFrame, flashpoints: DataFrame, more_than: int = 10):
    """(flashpoints, entries): merged entries, and only flashpoints with enough of them."""
    merged = dedup.merge_feeds(article_lists, feeds)
    kept = filters.with_enough_children(flashpoints, merged, "flashpoint_id", more_than)
    return kept, merged.join(kept.select("flashpoint_id"), "flashpoint_id", "left_semi")


def store_day(
    flashpoints: DataFrame, entries: DataFrame, run_id: str, as_of: datetime, path: str
) -> dict[str, str]:
    """Replace the day's parents and children; a second run gives the same tables."""
    day = f"{as_of:%Y-%m-%d}"
    parents = sinks.stored_flashpoints(flashpoints, run_id, day)
    children = sinks.stored_feeds(entries, flashpoints, run_id, day)
    out = {"flashpoint": f"{path}/flashpoint", "feed": f"{path}/feed"}
    sinks.replace_day(parents, out["flashpoint"], day)
    sinks.replace_day(children, out["feed"], day)
    return out
