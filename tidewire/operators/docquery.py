"""Document filters: each function validates its arguments and returns a Column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tidewire import fixed
from tidewire.functions import urls
from tidewire.functions.text import words_of

OneOrMany = str | Sequence[str]


def _many(value: OneOrMany) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _combine(parts: Sequence[Column], method: str) -> Column:
    if method not in ("AND", "OR"):
        raise ValueError(f"method is AND or OR, not {method}")
    return reduce(and_ if method == "AND" else or_, parts)


def phrase(text: Column, value: str) -> Column:
    """The exact phrase as whole words, ignoring case."""
    return F.lower(text).rlike(
        r"(?:^|[^\p{L}\p{N}_])" + re.escape(value.lower()) + r"(?:$|[^\p{L}\p{N}_])"
    )


def keyword(text: Column, value: OneOrMany) -> Column:
    """One phrase, a list, or a ";"-separated list; several mean any of them."""
    if isinstance(value, str):
        value = [v.strip() for v in value.split(";") if v.strip()]
    return _combine([phrase(text, v) for v in value], "OR")


def domain(url: Column, value: OneOrMany) -> Column:
    h = urls.host(url)
    return _combine([F.contains(h, F.lit(v)) for v in _many(value)], "OR")


def domain_exact(url: Column, value: OneOrMany) -> Column:
    return urls.host(url).isin(*_many(value))


def one_of(col: Column, value: OneOrMany) -> Column:
    return col.isin(*_many(value))


def theme(themes: Column, value: OneOrMany) -> Column:
    return F.arrays_overlap(themes, F.array(*[F.lit(v) for v in _many(value)]))


def tone(col: Column, condition: str, absolute: bool = False) -> Column:
    """``>n`` or ``<n``; lists and ``=`` are rejected."""
    if not isinstance(condition, str):
        raise NotImplementedError("only one tone condition is supported")
    if "=" in condition or not ("<" in condition or ">" in condition):
        raise ValueError("a tone condition needs < or > and no =")
    found = re.fullmatch(r"\s*([<>])\s*(-?\d+(?:\.\d+)?)\s*", condition)
    if not found:
        raise ValueError(f"unreadable tone condition {condition!r}")
    side = F.abs(col) if absolute else col
    bound = float(found.group(2))
    return side > bound if found.group(1) == ">" else side < bound


def near(text: Column, n: int, *words: str) -> Column:
    """All words occur with at most ``n`` token positions between first and last.

    One pass over the occurrences keeps the latest position of every word.
    """
    if len(words) < 2:
        raise ValueError("near needs at least two words")
    wanted = [w.lower() for w in words]
    tokens = F.transform(words_of(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.filter(tokens, lambda t: t["w"].isin(*wanted))
    none = -(10**9)
    start = F.struct(
        *[F.lit(none).alias(f"p{k}") for k in range(len(wanted))], F.lit(False).alias("hit")
    )

    def step(acc: Column, t: Column) -> Column:
        last = [
            F.when(t["w"] == w, t["i"]).otherwise(acc[f"p{k}"]) for k, w in enumerate(wanted)
        ]
        oldest = F.least(*last)
        hit = acc["hit"] | ((oldest > none) & (t["i"] - oldest <= n))
        return F.struct(*[p.alias(f"p{k}") for k, p in enumerate(last)], hit.alias("hit"))

    return F.aggregate(hits, start, step, lambda acc: acc["hit"])


def multi_near(text: Column, nears: Sequence[tuple], method: str = "OR") -> Column:
    return _combine([near(text, n, *words) for n, *words in nears], method)


def repeat(text: Column, n: int, word: str) -> Column:
    if " " in word:
        raise ValueError("only single words can be repeated")
    return F.size(F.filter(words_of(text), lambda w: w == word.lower())) >= n


def multi_repeat(text: Column, repeats: Sequence[tuple[int, str]], method: str) -> Column:
    return _combine([repeat(text, n, w) for n, w in repeats], method)


def timespan_start(span: str, as_of: datetime) -> datetime:
    """Start of a relative time span such as 90min, 24h, 7d, 2w or 1m (30 days)."""
    found = re.fullmatch(r"(\d+)([a-z]+)", span)
    if not found or found.group(2) not in fixed.TIMESPAN_UNITS:
        raise ValueError(f"unsupported time span {span!r}")
    value, unit = int(found.group(1)), fixed.TIMESPAN_UNITS[found.group(2)]
    if unit == "minutes" and value < 60:
        raise ValueError("a time span is at least 60 minutes")
    if unit == "months":
        return as_of - timedelta(days=30 * value)
    return as_of - timedelta(**{unit: value})


def search(
    df: DataFrame,
    as_of: datetime,
    *conditions: Column,
    start_date: datetime | None = None,
    end_date: datetime | None = None,
    timespan: str | None = None,
    max_records: int | None = 100,
    ts: str = "published_at",
    key: str = "id",
) -> DataFrame:
    """Newest rows that meet all conditions inside a date range or time span."""
    if (start_date or end_date) and timespan:
        raise ValueError("give a date range or a time span, not both")
    if timespan:
        lo, hi = timespan_start(timespan, as_of), as_of
    elif start_date and end_date:
        lo, hi = start_date, end_date
    else:
        raise ValueError("a start and an end date, or a time span, is needed")
    out = df.where(F.col(ts).between(F.lit(lo), F.lit(hi)))
    for cond in conditions:
        out = out.where(cond)
    if max_records:
        out = out.orderBy(F.desc(ts), key).limit(max_records)
    return out
