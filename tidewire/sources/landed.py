"""Readers of landed files: feeds, article lists, timelines, pages, stored days."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions import dates, urls
from tidewire.functions.text import html_text, language_code
from tidewire.operators.filters import recent_entries
from tidewire.operators.scans import top_k

RSS_SCHEMA = (
    "title string, description string, link string, pubDate string, source string"
)
EVENT_SCHEMA = (
    "articles array<struct<seendate:string,url:string,title:string,domain:string,"
    "language:string,sourcecountry:string,socialimage:string,nummentions:int,avgtone:double,"
    "mentions:array<map<string,string>>>>"
)
TIMELINE_SCHEMA = (
    "timeline array<struct<series:string,data:array<struct<date:string,value:double,norm:long>>>>"
)
FLASHPOINT_SCHEMA = (
    "title string, description string, entities array<string>, domains array<string>"
)


def read_rss(spark: SparkSession, path: str, as_of: datetime, per_feed: int = 50) -> DataFrame:
    """Articles of landed RSS files, the first ``per_feed`` items of each file."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path)
    return rss_articles(with_feed(raw), as_of, per_feed)


def with_feed(raw: DataFrame) -> DataFrame:
    """Add the file as ``feed`` and the item order as ``pos`` (a file is read by one task)."""
    return raw.select(
        "*", F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("pos")
    )


def rss_articles(items: DataFrame, as_of: datetime, per_feed: int | None = 50) -> DataFrame:
    if per_feed:
        items = top_k(items, ["feed"], per_feed, F.col("pos")).drop("rank")
    return items.select(
        "feed",
        "pos",
        "title",
        "description",
        F.col("link").alias("url"),
        F.coalesce("source", F.lit("Google News")).alias("source"),
        F.coalesce(dates.parse_rfc822(F.col("pubDate")), F.lit(as_of)).alias("published_at"),
        F.lit("en").alias("language"),
        F.lit("US").alias("country"),
        F.lit("geopolitics").alias("category"),
    )


def read_article_list(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of landed article-list JSON documents."""
    docs = spark.read.schema(EVENT_SCHEMA).json(path)
    return docs.select(F.posexplode("articles").alias("pos", "a")).select("pos", "a.*")


def article_list_events(entries: DataFrame) -> DataFrame:
    """Events; rows whose time does not read are dropped."""
    ts = F.when(
        F.col("seendate").rlike(r"^\d{14}$"), F.try_to_timestamp("seendate", F.lit("yyyyMMddHHmmss"))
    )
    return entries.select(
        F.col("seendate").alias("event_id"),
        ts.alias("event_time"),
        F.col("url").alias("source_url"),
        F.coalesce("nummentions", F.lit(0)).alias("num_mentions"),
        F.coalesce("avgtone", F.lit(0.0)).alias("avg_tone"),
        "mentions",
    ).where("event_time IS NOT NULL")


def article_list_projection(entries: DataFrame) -> DataFrame:
    return entries.select(
        "title",
        "url",
        F.col("socialimage").alias("image"),
        F.col("seendate").alias("seen_date"),
        "domain",
        "language",
        F.col("sourcecountry").alias("country"),
    )


def article_list_feed(entries: DataFrame, as_of: datetime, days: int = 2) -> DataFrame:
    """Feed entries of projected article lists; unreadable dates stay, with an empty day."""
    seen = dates.parse_seen(F.col("seen_date"))
    return recent_entries(entries, seen, as_of, days).select(
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        dates.seen_date(F.col("seen_date")).alias("seendate"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        language_code(F.col("language")).alias("language"),
        F.coalesce("country", F.lit("")).alias("sourcecountry"),
        F.coalesce("title", F.lit("")).alias("description"),
        F.coalesce("image", F.lit("")).alias("image"),
    )


def rss_feed(items: DataFrame, as_of: datetime, days: int = 2, min_entries: int = 2) -> DataFrame:
    """Feed entries of RSS items by ``feed_url``; feeds with too few items are left out."""
    sizes = items.groupBy("feed_url").agg(F.count("*").alias("n")).where(F.col("n") >= min_entries)
    seen = dates.parse_rfc822(F.col("pubDate"))
    full = items.join(sizes, "feed_url", "left_semi")
    return recent_entries(full, seen, as_of, days).select(
        "feed_url",
        F.col("link").alias("url"),
        "title",
        F.coalesce(F.date_format(seen, "yyyy-MM-dd"), F.lit("")).alias("seendate"),
        urls.feed_language(F.col("feed_url")).alias("language"),
        "description",
    )


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(series, date, value, norm) rows of landed timeline JSON."""
    docs = spark.read.schema(TIMELINE_SCHEMA).json(path)
    return (
        docs.select(F.explode("timeline").alias("t"))
        .select("t.series", F.explode("t.data").alias("d"))
        .select("series", "d.date", "d.value", "d.norm")
    )


def wide_timeline(points: DataFrame, names: list[str], with_norm: bool = False) -> DataFrame:
    """One column per series; raw volume also gives the norm as "All Articles"."""
    wide = points.groupBy(F.col("date").alias("datetime")).pivot("series", names).agg(F.first("value"))
    if not with_norm:
        return wide
    norm = points.groupBy(F.col("date").alias("datetime")).agg(F.max("norm").alias("All Articles"))
    return wide.join(norm, "datetime")


def page_texts(pages: DataFrame, min_length: int = 100) -> DataFrame:
    """Visible text of landed pages, only those longer than ``min_length``."""
    return pages.withColumn("text", html_text(F.col("html"))).drop("html").where(F.length(F.trim("text")) > min_length)


def gather_context(
    results: DataFrame, group: str = "query", max_articles: int = 10, min_length: int = 100
) -> DataFrame:
    """(query, context, n): texts of the first results, at least ``min_length`` long, blank line between."""
    first = top_k(results, [group], max_articles, F.col("pos")).where(F.length(F.trim("text")) >= min_length)
    texts = F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t"))))
    return first.groupBy(group).agg(
        F.array_join(F.transform(texts, lambda s: s["t"]), "\n\n").alias("context"),
        F.count("*").alias("n"),
    )


def read_day(spark: SparkSession, path: str, day: str, table: str = "parquet") -> DataFrame:
    """One day of a table partitioned by ``dt``; other days are pruned before the scan."""
    return spark.read.format(table).load(path).where(F.col("dt") == F.lit(day).cast("date"))


def day_table_name(base: str, day: Column) -> Column:
    return F.concat(F.lit(base + "_"), F.date_format(day, "yyyyMMdd"))


def read_flashpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLASHPOINT_SCHEMA).json(path, multiLine=True)


class SourceRegistry:
    """User-defined sources: a name and a reader that gives article columns."""

    REQUIRED = ("title", "url", "source", "published_at")

    def __init__(self) -> None:
        self._readers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, reader: Callable[[SparkSession], DataFrame]) -> None:
        self._readers[name] = reader

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        df = self._readers[name](spark)
        missing = [c for c in self.REQUIRED if c not in df.columns]
        if missing:
            raise ValueError(f"source {name} lacks {missing}")
        return df.withColumn("source_name", F.lit(name))

    def read_all(self, spark: SparkSession) -> DataFrame:
        frames = [self.read(spark, n) for n in self._readers]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out
