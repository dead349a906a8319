"""Address functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

FEED_BASE = "https://news.google.com/rss/search"


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def well_formed(url: Column) -> Column:
    """Scheme and host are present."""
    scheme = F.try_parse_url(url, F.lit("PROTOCOL"))
    return F.coalesce(scheme.isNotNull() & host(url).isNotNull(), F.lit(False))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://"), F.lit(False))


def feed_language(url: Column) -> Column:
    """``hl`` before its hyphen, else the second part of ``ceid``."""
    hl = F.try_parse_url(url, F.lit("QUERY"), F.lit("hl"))
    ceid = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("ceid")))
    from_ceid = F.when(F.contains(ceid, F.lit(":")), F.split_part(ceid, F.lit(":"), F.lit(2)))
    return F.coalesce(F.split_part(hl, F.lit("-"), F.lit(1)), from_ceid)


def quote_query(text: Column) -> Column:
    """Form encoding: blanks become plus, ``*`` is escaped and ``~`` is not."""
    coded = F.url_encode(F.trim(text))
    coded = F.replace(coded, F.lit("*"), F.lit("%2A"))
    return F.replace(coded, F.lit("%7E"), F.lit("~"))


def country_for_language(lang: Column, entity_languages: Column) -> Column:
    """First entity (in entry order) whose language list holds ``lang``."""
    hits = F.filter(
        F.map_entries(entity_languages), lambda e: F.array_contains(e["value"], lang)
    )
    return F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["key"])


def feed_url(query: Column, lang: Column, country: Column) -> Column:
    """Search feed address; ``ceid`` is added only when a country is known."""
    ceid = F.concat(F.lit("&ceid="), F.upper(country), F.lit(":"), F.upper(lang))
    base = F.concat(F.lit(FEED_BASE + "?q="), quote_query(query), F.lit("&hl="), F.lower(lang))
    return F.concat(base, F.coalesce(ceid, F.lit("")))


def feed_country_fallback(lang: Column, entity_languages: Column, entities: Column) -> Column:
    """Country having the language, else the first entity, else ``US``."""
    return F.coalesce(
        country_for_language(lang, entity_languages), F.get(entities, F.lit(0)), F.lit("US")
    )


def path_has_any(url: Column, words: Sequence[str]) -> Column:
    pattern = "|".join(w.replace("-", r"\-") for w in words)
    return F.coalesce(F.lower(url).rlike(pattern), F.lit(False))
