"""Query expansion: languages, entity combinations, feed addresses."""

from __future__ import annotations

from datetime import datetime, timedelta
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewire import fixed
from tidewire.functions.urls import country_for_language, feed_url
from tidewire.operators.dedup import first_per_key

#: Entities whose subsets one row is unfolded to at once; those of the others are dealt out first.
LOW_BITS = 8


def expand_languages(
    queries: DataFrame, translations: DataFrame, passthrough: Sequence[str] = fixed.PASSTHROUGH_LANGS
) -> DataFrame:
    """One row per query and target language, with text and status.

    ``translations(text, language, translated)`` is the lookup. English-like
    languages keep the text; codes longer than two characters are unsupported;
    a missing translation keeps the original with status "failed".
    """
    rows = queries.withColumn("language", F.explode("languages"))
    same = F.col("language").isin(*passthrough)
    found = F.col("translated").isNotNull()
    table = translations.select(F.col("text").alias("query"), "language", "translated")
    return rows.join(table, ["query", "language"], "left").withColumns(
        {
            "query_translated": F.when(same, F.col("query")).otherwise(F.coalesce("translated", "query")),
            "status": F.when(F.length("language") > 2, "unsupported")
            .when(same, "same")
            .when(found, "translated")
            .otherwise("failed"),
        }
    ).drop("translated")


def batch_translate(texts: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """Translated text per row, the original where none is known."""
    table = translations.where(F.col("language") == language).select("text", "translated")
    return texts.join(table, "text", "left").withColumn("translated", F.coalesce("translated", "text"))


def entity_combinations(
    queries: DataFrame, as_of: datetime, max_records: int = 250, min_length: int = 5
) -> DataFrame:
    """Search combinations: every non-empty entity subset with every country of the query.

    Columns ``query_pos, entities, countries`` are read. A subset equal to the
    country is skipped, (keyword, country) pairs are unique over all queries,
    first query wins, and short keywords are padded. Queries of more than one
    entity also give one combination without a country. The subsets come from
    the bits of a counter. Its high bits are unfolded first and dealt to all
    tasks, the low bits there, so a long list is no long array in one task.
    """
    day = lambda d: F.lit(f"{d:%Y-%m-%d}")
    n = F.size("entities")
    small = queries.where((n > 0) & (F.size("countries") > 0))
    low = F.least(n, F.lit(LOW_BITS))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.expr("1L") * F.pow(F.lit(2.0), k).cast("long") - 1)
    subset = F.filter("entities", lambda _, i: F.getbit(F.col("bits"), i) == 1)
    pairs = (
        small.select("query_pos", "entities", "countries", F.explode(upto(n - low)).alias("high"))
        .repartition("query_pos", "high")
        .withColumn("bits", F.explode(upto(low)))
        .withColumn("bits", F.col("high") * F.pow(F.lit(2.0), low).cast("long") + F.col("bits"))
        .where("bits > 0")
        .withColumn("subset", subset)
        .select("query_pos", "bits", "subset", F.explode("countries").alias("country"))
        .withColumn("keyword", F.array_join("subset", ", "))
        .where("keyword <> country")
    )
    unique = first_per_key(pairs, ["keyword", "country"], "query_pos", "bits")
    default = small.where(n > 1).select(
        "query_pos",
        F.lit(0).cast("long").alias("bits"),
        F.col("entities").alias("subset"),
        F.lit(None).cast("string").alias("country"),
        F.array_join("entities", ", ").alias("keyword"),
    )
    default = first_per_key(default, ["keyword"], "query_pos")
    return unique.unionByName(default).select(
        "query_pos",
        F.col("subset").alias("entities"),
        F.when(F.col("country").isNotNull(), F.rpad("keyword", F.greatest(F.length("keyword"), F.lit(min_length)), F.lit(" ")))
        .otherwise(F.col("keyword"))
        .alias("keyword"),
        "country",
        day(as_of - timedelta(days=1)).alias("start_date"),
        day(as_of).alias("end_date"),
        F.lit(max_records).alias("maxrecords"),
    )


def feed_urls(translated: DataFrame) -> DataFrame:
    """Distinct search feed addresses per query from its translated texts."""
    country = country_for_language(F.col("language"), F.col("entity_languages"))
    url = feed_url(F.col("query_translated"), F.col("language"), country)
    return translated.select("query_pos", url.alias("feed_url")).distinct()
