"""Date parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The five date shapes article lists use, with the shape of each
# so that a lenient parser cannot read one as another.
DATE_SHAPES = (
    (r"^\d{8}T\d{6}Z$", "yyyyMMdd'T'HHmmss'Z'"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
)


def parse_seen(text: Column) -> Column:
    """Timestamp of any of the five shapes, else NULL."""
    tries = [F.when(text.rlike(rx), F.try_to_timestamp(text, F.lit(p))) for rx, p in DATE_SHAPES]
    return F.coalesce(*tries)


def seen_date(text: Column) -> Column:
    """``yyyy-MM-dd`` or the empty string."""
    return F.coalesce(F.date_format(parse_seen(text), "yyyy-MM-dd"), F.lit(""))


def parse_rfc822(text: Column) -> Column:
    """Timestamp of an RFC-822 date; the weekday is cut off because Spark cannot parse it."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    named = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z"))
    offset = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(named, offset)


def rfc822_date(text: Column) -> Column:
    return F.date_format(parse_rfc822(text), "yyyy-MM-dd")


def api_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def api_date_text(day: Column) -> Column:
    """Same for a ``yyyy-MM-dd`` string."""
    return F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit("000000"))


def as_instant(col: Column) -> Column:
    """Zone-less timestamps read from Parquet become instants of the session zone (UTC)."""
    return col.cast("timestamp")
