"""Article, item, query and stored-table filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewire import fixed
from tidewire.functions import urls
from tidewire.functions.scores import filled
from tidewire.functions.text import clean_body, clean_line, contains_any, joined_keywords, words_of
from tidewire.session import cut_lineage


def valid_articles(df: DataFrame, as_of: datetime, max_days: int = 30, min_title: int = 10) -> DataFrame:
    """Long enough title, an address, and not too old."""
    return df.where(
        (F.length(F.trim("title")) >= min_title)
        & filled(F.col("url"))
        & (F.col("published_at") >= F.lit(as_of - timedelta(days=max_days)))
    )


def clean_articles(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "title": clean_line(F.col("title")),
            "description": clean_line(F.col("description")),
            "content": clean_body(F.col("content")),
        }
    )


def item_is_valid(require_http: bool = False) -> Column:
    ok = filled(F.col("title")) & filled(F.col("url"))
    return ok & urls.is_http(F.col("url")) if require_http else ok


def unify(articles: DataFrame, events: DataFrame) -> DataFrame:
    """One table of articles and events; an event's content is its title."""
    common = ["pos", "title", "url", "source", "published_date"]
    left = articles.select(F.lit("article").alias("type"), *common, F.col("snippet").alias("content"))
    right = events.select(F.lit("event").alias("type"), *common, F.col("title").alias("content"))
    return left.unionByName(right)


def standardize(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Standard fields with "" (type: "unknown") for missing ones, plus the original field names."""
    fields = ["title", "url", "source", "published_date", "content"]
    text = {
        c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        for c in fields
    }
    kind = F.coalesce(F.col("type"), F.lit("unknown")) if "type" in df.columns else F.lit("unknown")
    keys = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(df.columns)])
    )
    return df.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        *[c.alias(n) for n, c in text.items()],
        kind.alias("type"),
        keys.alias("original_keys"),
    )


def recent_entries(df: DataFrame, seen: Column, as_of: datetime, days: int = 2) -> DataFrame:
    """Drop rows older than ``days``; rows without a readable date stay."""
    return df.where(seen.isNull() | (seen >= F.lit(as_of - timedelta(days=days))))


def max_age(df: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return df.where(F.col("published_at") >= F.lit(as_of - timedelta(hours=hours)))


def without_terms(df: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """Rows that name none of a short list of terms."""
    return df.where(~contains_any(F.lower(text), [t.lower() for t in terms]))


def without_seen_words(df: DataFrame, key: str, text: Column, seen: DataFrame) -> DataFrame:
    """Rows none of whose words is in ``seen(term)``, for lists too long for a pattern."""
    hits = (
        df.select(key, F.explode(F.array_distinct(words_of(text))).alias("term"))
        .join(seen.select("term").distinct(), "term", "left_semi")
        .select(key)
    )
    return df.join(hits, key, "left_anti")


def exclusion_text(seen: DataFrame, term: str = "term") -> DataFrame:
    """The exclusion part of a search text, for a seen list that fits one search."""
    quoted = F.concat(F.lit('-"'), F.lower(F.trim(term)), F.lit('"'))
    return seen.agg(F.array_join(F.array_sort(F.collect_set(quoted)), " ").alias("exclude_query"))


def news_urls(df: DataFrame, words: Sequence[str] = fixed.NEWS_URL_WORDS) -> DataFrame:
    return df.where(urls.path_has_any(F.col("url"), words))


def matches_subscription(prefix: str = "sub_") -> Column:
    """True when an article row fits the filter columns of a subscription row.

    Empty or NULL lists and zero thresholds pass everything. Country and keyword
    tests are substring tests, category and language tests are membership tests.
    ``_joined`` holds the article's joined keywords; subscription keywords are
    lower case.
    """
    c = lambda n: F.col(prefix + n)
    free = lambda n: c(n).isNull() | (F.size(c(n)) == 0)
    floor = lambda col, n: (F.coalesce(c(n), F.lit(0.0)) == 0.0) | (F.col(col) >= c(n))
    return (
        (free("categories") | F.arrays_overlap(F.col("categories"), c("categories")))
        & (free("countries") | F.exists(c("countries"), lambda x: F.contains(F.col("country"), x)))
        & (free("keywords") | F.exists(c("keywords"), lambda x: F.contains(F.col("_joined"), x)))
        & floor("relevance", "min_relevance")
        & floor("quality", "min_quality")
        & (free("languages") | F.array_contains(c("languages"), F.col("language")))
    )


#: Columns of a subscription that decide what it matches.
FILTERS = ("categories", "countries", "keywords", "min_relevance", "min_quality", "languages")
#: Length of the pieces under which substring clauses are looked up; portions of what no list clause narrows down.
GRAM, PORTIONS = 12, 16
#: Subscriptions of one filter that are kept in one row of the written index.
CLIENTS = 1000
#: Bytes, as JSON, up to which a written table goes to all tasks; hash values that stand for the keys of a larger one.
SHARED, MARKS = 32_000_000, 1 << 20


def _grams(col: Column, size: int) -> Column:
    """All overlapping pieces of ``size`` characters, found in one pass by a look-ahead."""
    if size == 0:
        return F.array(F.lit(""))
    return F.coalesce(F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)), F.array().cast("array<string>"))


def _profiles(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with lower-case keywords, lists without NULL and repeats, and a ``profile`` that names the filter."""
    lists = {
        "categories": F.col("categories"), "countries": F.col("countries"), "languages": F.col("languages"),
        "keywords": F.transform("keywords", lambda k: F.lower(k)),
    }
    none = F.array().cast("array<string>")
    clean = {c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(v, none)))) for c, v in lists.items()}
    return subscriptions.withColumns(clean).withColumn("profile", F.to_json(F.struct(*FILTERS)))


def predicate_index(profiled: DataFrame) -> DataFrame:
    """(_key, _value, profile, sub_...): each distinct filter under the values of one of its list clauses.

    Countries and keywords are substrings, so they are found under their first ``GRAM`` characters; a
    filter without a list clause is found by all articles, in ``PORTIONS``.
    """
    filters = profiled.select("profile", *FILTERS).dropDuplicates(["profile"])

    def under(mark: str, values: str, length: int | None = None) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.concat(F.lit(mark), F.left(v, F.lit(length)) if length else v).alias("k"), v.alias("v"))
        )

    free = F.array(*[F.struct(F.lit(f"*{i}").alias("k"), F.lit("").alias("v")) for i in range(PORTIONS)])
    chosen = (
        F.when(F.size("countries") > 0, under("n:", "countries", GRAM))
        .when(F.size("keywords") > 0, under("k:", "keywords", GRAM))
        .when(F.size("languages") > 0, under("l:", "languages"))
        .when(F.size("categories") > 0, under("c:", "categories"))
        .otherwise(free)
    )
    each = filters.withColumn("_e", F.explode(chosen))
    return each.select(F.col("_e.k").alias("_key"), F.col("_e.v").alias("_value"), "profile", *[F.col(c).alias(f"sub_{c}") for c in FILTERS])


def _clients(profiled: DataFrame) -> DataFrame:
    """(profile, _clients): the subscriptions of each filter in portions of about ``CLIENTS``."""
    portions = profiled.groupBy("profile").agg(F.ceil(F.count("*") / CLIENTS).cast("int").alias("_of"))
    own = F.struct(*[c for c in profiled.columns if c not in (*FILTERS, "profile")])
    return (
        profiled.select("profile", own.alias("_client"), F.monotonically_increasing_id().alias("_at"))
        .join(portions, "profile")
        .groupBy("profile", F.pmod(F.xxhash64("_at"), F.col("_of")).alias("_portion"))
        .agg(F.collect_list("_client").alias("_clients"))
        .select("profile", "_clients")
    )


def _for_all_tasks(df: DataFrame) -> bool:
    """Whether a written table is small enough to be sent to all tasks, by its measured size."""
    return (df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) <= SHARED


class Routes:
    """Subscriptions, written once as a predicate index and the clients of each filter, for batches and streams.

    An article looks its filters up under its language, its categories and the pieces of its country and joined
    keywords, by an equi-join with the predicate index; a filter counts under the first of its values that the
    article has, so no match comes twice and a stream needs no state. The whole filter is then checked. An index of
    up to ``SHARED`` bytes goes to all tasks, so articles are not shuffled, and a key of many articles is
    not one task's; before a join with a larger one, pieces without the hash of one of its keys are dropped.
    """

    def __init__(self, subscriptions: DataFrame) -> None:
        self.columns = subscriptions.columns
        profiled = cut_lineage(_profiles(subscriptions))
        numbers = cut_lineage(profiled.select("profile").distinct().withColumn("_filter", F.monotonically_increasing_id()))
        self.clients = cut_lineage(_clients(profiled).join(numbers, "profile").drop("profile"))
        self.index = cut_lineage(predicate_index(profiled).join(numbers, "profile").drop("profile"))
        lengths = [F.transform(c, lambda v: F.least(F.length(v), F.lit(GRAM))) for c in ("countries", "keywords")]
        # At most GRAM + 1 values.
        self.sizes = [sorted(r[0] for r in profiled.select(F.explode(n).alias("n")).distinct().collect()) for n in lengths]

    def matches(self, articles: DataFrame) -> DataFrame:
        """Each article with the filters that it fits: its columns, those of the filter and ``_filter``, its number."""
        return self._hits(articles, self.index).select(*articles.columns, *[f"sub_{c}" for c in FILTERS], "_filter")

    def clients_of(self, matches: DataFrame) -> DataFrame:
        """A row for each client of the filter ``_filter``, where the clients stand as ``sub_...`` beside what is there."""
        clients = F.broadcast(self.clients) if _for_all_tasks(self.clients) else self.clients
        own = [F.col(f"_client.{c}").alias(f"sub_{c}") for c in self.columns if c not in FILTERS]
        kept = [c for c in matches.columns if c != "_filter"]
        return matches.join(clients, "_filter").withColumn("_client", F.explode("_clients")).select(*kept, *own)

    def pairs(self, articles: DataFrame) -> DataFrame:
        """(article, client) pairs; the clients come with the index, so matches become pairs in place."""
        hits = self._hits(articles, cut_lineage(self.index.join(self.clients, "_filter").drop("_filter")))
        sub = lambda c: F.col(f"sub_{c}" if c in FILTERS else f"_client.{c}").alias(f"sub_{c}")
        return hits.withColumn("_client", F.explode("_clients")).select(*articles.columns, *[sub(c) for c in self.columns])

    def _hits(self, articles: DataFrame, index: DataFrame) -> DataFrame:
        joined = articles.withColumn("_joined", joined_keywords(F.col("keywords")))

        def marked(mark: str, values: Column) -> Column:
            return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(mark), v))

        portion = F.pmod(F.xxhash64("_joined", "country", "language", "relevance", "quality"), F.lit(PORTIONS))
        keys = F.concat(
            *[marked("n:", _grams(F.col("country"), n)) for n in self.sizes[0]],
            *[marked("k:", _grams(F.col("_joined"), n)) for n in self.sizes[1]],
            marked("l:", F.array("language")), marked("c:", F.col("categories")),
            F.array(F.concat(F.lit("*"), portion.cast("string"))),
        )
        asked = joined.withColumn("_key", F.explode(F.array_distinct(F.array_compact(keys))))
        if _for_all_tasks(index):
            index = F.broadcast(index)
        else:
            # At most MARKS rows.
            mark = F.pmod(F.xxhash64("_key"), F.lit(MARKS))
            marks = cut_lineage(index.select(mark.alias("_mark")).distinct())
            asked = asked.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")
        found = asked.join(index, "_key")
        first = (
            F.when(F.col("_key").startswith("n:"), F.get(F.filter("sub_countries", lambda v: F.contains(F.col("country"), v)), F.lit(0)))
            .when(F.col("_key").startswith("k:"), F.get(F.filter("sub_keywords", lambda v: F.contains(F.col("_joined"), v)), F.lit(0)))
            .when(F.col("_key").startswith("c:"), F.get(F.filter("sub_categories", lambda v: F.array_contains(F.col("categories"), v)), F.lit(0)))
            .otherwise(F.col("_value"))
        )
        return found.where((first == F.col("_value")) & matches_subscription())


def route_to_subscribers(articles: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(article, client) pairs whose filter matches; batch or stream on the left. Neither matches nor pairs are shuffled."""
    return Routes(subscriptions).pairs(articles)


def stored(
    df: DataFrame,
    equals: dict[str, object] | None = None,
    overlaps: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Equality filters (pushed to the scan) and array-overlap filters of a stored table."""
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    for name, values in (overlaps or {}).items():
        df = df.where(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])))
    return df


def unprocessed_children(df: DataFrame) -> DataFrame:
    """Ids of stored children without content."""
    return df.where(
        (F.coalesce("content", F.lit("")) == "")
        & F.col("id").isNotNull()
        & F.col("flashpoint_id").isNotNull()
    ).select("id", "flashpoint_id")


def with_enough_children(parents: DataFrame, children: DataFrame, key: str, more_than: int = 10) -> DataFrame:
    full = children.groupBy(key).count().where(F.col("count") > more_than)
    return parents.join(full, key, "left_semi")


def entity_count_between(lo: int = 1, hi: int = 10) -> Column:
    return F.size("entities").between(lo, hi)


def flashpoint_fields_present() -> Column:
    return filled(F.col("title")) & filled(F.col("description")) & (F.size("entities") > 0)


def clean_query_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Parsed reply rows: trimmed query, non-blank entities; empty queries are dropped."""
    schema = "array<struct<query:string,entities:array<string>>>"
    q = F.trim("item.query")
    ents = F.filter(
        F.transform(F.coalesce("item.entities", F.array().cast("array<string>")), lambda e: F.trim(e)),
        lambda e: e != "",
    )
    return (
        df.withColumn("item", F.explode(F.from_json(reply, schema)))
        .select(*[c for c in df.columns if c != reply], q.alias("query"), ents.alias("entities"))
        .where(filled(F.col("query")))
    )


def recent(df: DataFrame, as_of: datetime, days: int = 7, limit: int = 50) -> DataFrame:
    return (
        df.where(F.col("created_at") >= F.lit(as_of - timedelta(days=days)))
        .orderBy(F.desc("created_at"), "id")
        .limit(limit)
    )


def split_by_decision(df: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(approved, rejected) by a decision table; no readable "yes" means rejected."""
    yes = decisions.where(F.lower(F.trim("decision")) == "yes").select(key).distinct()
    return df.join(yes, key, "left_semi"), df.join(yes, key, "left_anti")


def by_id(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))
