"""Views over the shared tables, once as DataFrames and once as SQL, and the registry."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire import fixed
from tidewire.functions import text as tx
from tidewire.session import use_settings

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

# Words that occur in the tables; they stand in for the default lists.
CATS = {
    "alpha": ("ation", "ement"),
    "beta": ("ersch", "ichen"),
    "gamma": ("eaux", "elle"),
    "delta": ("thing", "there"),
    "epsilon": ("ando", "ción"),
}
CONFLICT = ("tion", "sch", "aile")
URGENT = ("ther", "eau")
THEMES = ("the", "der", "que", "tion", "sch", "eau", "thing", "ando", "worthless", "pathetic")
RELEVANT_CATS = ("alpha", "beta")
RELEVANT_WORDS = ("that", "nicht", "dans", "para", "with")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the SQL views its check needs."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(use_settings(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return fn

    return register


# --------------------------------------------------------------------------
# DataFrame views
# --------------------------------------------------------------------------


class Tables:
    """The tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def article(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(
            d.alias("id"),
            d.alias("pos"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("description"),
            F.col("text").alias("content"),
            F.concat(F.lit("http://"), "source", F.lit(".example.com/"), (d % 900).cast("string")).alias("url"),
            "source",
            F.timestamp_seconds(1704067200 + (d * 37 % 43200) * 60).alias("published_at"),
            F.col("lang").alias("language"),
            F.concat(F.lit("NATION_"), (d % 25).cast("string")).alias("country"),
        )

    def processed(self) -> DataFrame:
        p = F.col("pos")
        body = F.concat_ws(" ", "title", "description")
        return self.article().select(
            "id", "pos", "title", "description", "url", "source", "published_at", "language", "country",
            tx.keywords(body).alias("keywords"),
            tx.categories(body, CATS).alias("categories"),
            F.when(p % 17 == 0, F.lit(None)).otherwise(((p * 37) % 201 - 100) / 100.0).alias("sentiment"),
            ((p * 13 % 101) / 100.0).alias("relevance"),
            ((p * 29 % 101) / 100.0).alias("quality"),
            F.transform(
                tx.entity_candidates(F.col("title")),
                lambda w: F.struct(w.alias("text"), label_of(w).alias("label")),
            ).alias("entities"),
        )

    def flashpoint(self) -> DataFrame:
        """Twenty rows per run; two keywords and, for two rows of three, a nation as entities."""
        p = F.col("pos")
        nation = F.when(p % 3 != 2, F.array("country")).otherwise(F.array().cast("array<string>"))
        return self.processed().select(
            "id", "pos",
            F.floor(p / 20).cast("long").alias("run_id"),
            "title", "description",
            F.concat(F.slice("keywords", 1, 2), nation).alias("entities"),
            F.col("categories").alias("domains"),
            F.col("published_at").alias("created_at"),
            "language", "source",
        )

    def feed(self) -> DataFrame:
        """Feed entries: every article belongs to the flashpoint of its block of fifteen."""
        p = F.col("pos")
        return self.article().select(
            "id", "pos",
            F.floor(p / 15).cast("long").alias("flashpoint_id"),
            (p % 3).alias("query_pos"),
            "title", "url", "language",
            F.concat("source", F.lit(".example.com")).alias("domain"),
            F.col("published_at").alias("created_at"),
            F.when(p % 4 == 0, F.lit(None)).when(p % 4 == 1, F.lit("")).otherwise(F.col("description")).alias("content"),
        )

    def hotspot(self) -> DataFrame:
        """One hotspot per ten articles."""
        p = F.col("pos")
        ordered = lambda c: F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda s: s["v"]
        )
        first = lambda c: F.min_by(c, "pos")
        return (
            self.processed()
            .groupBy(F.floor(p / 10).cast("long").alias("id"))
            .agg(
                first("title").alias("title"),
                first("description").alias("summary"),
                ordered("url").alias("article_urls"),
                F.round(F.avg("quality"), 8).alias("confidence_score"),
                F.max("published_at").alias("created_at"),
                first("categories").alias("domains"),
                first("keywords").alias("kw"),
            )
            .select(
                "id", "title", "summary",
                F.when(F.col("id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.col("article_urls")).alias("article_urls"),
                "confidence_score", "created_at", "domains",
                F.when(F.col("id") % 7 == 0, F.lit("{broken"))
                .otherwise(
                    F.concat(
                        F.lit("["),
                        F.array_join(
                            F.transform(
                                F.slice("kw", 1, 3),
                                lambda w: F.concat(F.lit('{"name":"'), w, F.lit('","type":"word"}')),
                            ),
                            ",",
                        ),
                        F.lit("]"),
                    )
                )
                .alias("entities_json"),
            )
        )

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def agent_log(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").alias("pos"),
            F.col("event_type").alias("agent"),
            F.col("user_id").alias("run_id"),
            F.lit("run").alias("action"),
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
            F.col("value").alias("execution_time"),
            (F.get_json_object("props", "$.k").cast("long") % 3).alias("retries"),
            "props", "ts",
        )

    def request_log(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").alias("pos"), F.col("user_id").alias("client"), "ts"
        )

    def claim(self) -> DataFrame:
        """Eight claims per event, verdicts and source numbers from the event stream."""
        e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
        kind = F.col("event_type")
        return self.events().select(
            F.floor(e / 8).cast("long").alias("event_id"),
            (e % 8).alias("claim_pos"),
            F.when(kind.isin("click", "view"), "true")
            .when(kind == "purchase", "false")
            .otherwise("uncertain")
            .alias("verdict"),
            F.array(k % 5).alias("supporting"),
            F.array(k % 7).alias("contradicting"),
        )

    def usage(self) -> DataFrame:
        n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
        out = F.col("role") == "assistant"
        return self.table("conversations").select(
            F.col("conv_id").alias("session"),
            "turn",
            F.lit("mistral").alias("provider"),
            F.when(F.col("turn") % 2 == 0, "mistral-large").otherwise("other").alias("model"),
            F.when(out, F.lit(0)).otherwise(n).cast("long").alias("input_tokens"),
            F.when(out, n).otherwise(F.lit(0)).cast("long").alias("output_tokens"),
        )

    def entity(self) -> DataFrame:
        """Nation names as customers might write them: exact, padded, coded, misspelt, unknown."""
        k, name = F.col("c_custkey"), F.col("n_name")
        nation = self.table("nation").select("n_nationkey", "n_name")
        text = (
            F.when(k % 6 == 0, name)
            .when(k % 6 == 1, F.concat(F.lit(" "), F.lower(name), F.lit(" ")))
            .when(k % 6 == 2, F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")))
            .when(k % 6 == 3, F.replace(name, F.lit("TI"), F.lit("T")))
            .when(k % 6 == 4, F.concat(F.lit("ZONE"), (k % 7).cast("string")))
            .otherwise(F.lit("NATO"))
        )
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(k.alias("id"), text.alias("entity"))
        )

    def entity_list(self) -> DataFrame:
        """Rows of four entities."""
        return (
            self.entity()
            .groupBy(F.floor(F.col("id") / 4).cast("long").alias("query_pos"))
            .agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("id", "entity"))), lambda s: s["entity"]
                ).alias("entities")
            )
        )

    def aliases(self) -> DataFrame:
        n = self.table("nation")
        exact = n.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("country"), F.lit(0).alias("priority"))
        code = n.select(
            F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("alias"),
            F.col("n_name").alias("country"), F.lit(1).alias("priority"),
        )
        return exact.unionByName(code)

    def countries(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        k = F.col("n_nationkey")
        lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "zh")]), (k % 5) + 1)
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("country"),
            F.concat(F.lit("C"), k.cast("string")).alias("alpha2"),
            F.concat(F.lit("G"), (k * 3).cast("string")).alias("gkg_code"),
            F.col("r_name").alias("region"),
            F.when(k % 2 == 0, F.array(lang)).otherwise(F.array(lang, F.lit("ar"))).alias("languages"),
        )

    def regions(self) -> DataFrame:
        zone = F.concat(F.lit("zone"), F.col("r_regionkey").cast("string"))
        return self.table("region").select(zone.alias("region"), F.array(F.lit("pt"), F.lit("en")).alias("languages"))

    def variants(self) -> DataFrame:
        from tidewire.sources import dims

        return dims.variants(self.spark)


def label_of(word: Column) -> Column:
    n = F.length(word) % 4
    return F.when(n == 0, "GPE").when(n == 1, "ORG").when(n == 2, "PERSON").otherwise("LOC")


def r8(col: Column | str) -> Column:
    return F.round(col, 8)


def joined(col: Column | str) -> Column:
    return F.array_join(col, "|")


def stamp(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --------------------------------------------------------------------------
# SQL views
# --------------------------------------------------------------------------

STAMP = "'%Y-%m-%d %H:%M:%S'"
TITLE_CASE_SQL = tx.TITLE_CASE
STOP_SQL = ", ".join(f"'{w}'" for w in fixed.KEYWORD_STOP_WORDS)


def keywords_sql(text: str) -> str:
    """Keywords of a short text; the word list is named once in a nested query."""
    words = (
        f"list_filter(regexp_extract_all(lower({text}), '{tx.WORD}'), "
        f"lambda w: length(w) > 3 AND w NOT IN ({STOP_SQL}))"
    )
    return f"(SELECT list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:10] FROM (SELECT {words} AS ws))"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def categories_sql(text: str, cats=CATS) -> str:
    cases = ", ".join(f"CASE WHEN {any_sql(f'lower({text})', ws)} THEN '{c}' END" for c, ws in cats.items())
    return f"list_filter([{cases}], lambda c: c IS NOT NULL)[1:3]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


SQL_VIEWS: dict[str, tuple[str, str]] = {
    "article": (
        "",
        """SELECT doc_id AS id, doc_id AS pos, split_part(text, chr(10), 1) AS title,
             text AS description, text AS content,
             'http://' || source || '.example.com/' || CAST(doc_id % 900 AS VARCHAR) AS url, source,
             TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 43200) AS published_at,
             lang AS language, 'NATION_' || CAST(doc_id % 25 AS VARCHAR) AS country
           FROM documents""",
    ),
    "processed": (
        "article",
        f"""SELECT id, pos, title, description, url, source, published_at, language, country,
             {keywords_sql("title || ' ' || description")} AS keywords,
             {categories_sql("title || ' ' || description")} AS categories,
             CASE WHEN pos % 17 = 0 THEN NULL ELSE ((pos * 37) % 201 - 100) / 100.0::DOUBLE END AS sentiment,
             (pos * 13 % 101) / 100.0::DOUBLE AS relevance, (pos * 29 % 101) / 100.0::DOUBLE AS quality,
             list_filter(regexp_split_to_array(trim(title), '\\s+'),
               lambda w: regexp_matches(w, '{TITLE_CASE_SQL}') AND length(w) > 2) AS entities
           FROM article""",
    ),
    "flashpoint": (
        "processed",
        """SELECT id, pos, pos // 20 AS run_id, title, description,
             keywords[1:2] || CASE WHEN pos % 3 <> 2 THEN [country] ELSE [] END AS entities,
             categories AS domains, published_at AS created_at, language, source
           FROM processed""",
    ),
    "feed": (
        "article",
        """SELECT id, pos, pos // 15 AS flashpoint_id, pos % 3 AS query_pos, title, url, language,
             source || '.example.com' AS domain, published_at AS created_at,
             CASE pos % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE description END AS content
           FROM article""",
    ),
    "hotspot": (
        "processed",
        """SELECT id, title, summary, CASE WHEN id % 9 = 0 THEN [] ELSE urls END AS article_urls,
             confidence_score, created_at, domains,
             CASE WHEN id % 7 = 0 THEN '{broken' ELSE '[' || array_to_string(list_transform(kw[1:3],
               lambda w: '{"name":"' || w || '","type":"word"}'), ',') || ']' END AS entities_json
           FROM (SELECT pos // 10 AS id, arg_min(title, pos) AS title, arg_min(description, pos) AS summary,
               list(url ORDER BY pos) AS urls, round(avg(quality), 8) AS confidence_score,
               max(published_at) AS created_at, arg_min(categories, pos) AS domains,
               arg_min(keywords, pos) AS kw
             FROM processed GROUP BY 1)""",
    ),
    "agent_log": (
        "",
        """SELECT event_id AS pos, event_type AS agent, user_id AS run_id, 'run' AS action,
             CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
             value AS execution_time, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS retries,
             props, ts
           FROM events""",
    ),
    "claim": (
        "",
        """SELECT event_id // 8 AS event_id, event_id % 8 AS claim_pos,
             CASE WHEN event_type IN ('click', 'view') THEN 'true' WHEN event_type = 'purchase' THEN 'false'
               ELSE 'uncertain' END AS verdict,
             CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS s,
             CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS c
           FROM events""",
    ),
    "usage": (
        "",
        """SELECT conv_id AS session, turn, 'mistral' AS provider,
             CASE WHEN turn % 2 = 0 THEN 'mistral-large' ELSE 'other' END AS model,
             CASE WHEN role = 'assistant' THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) END AS input_tokens,
             CASE WHEN role = 'assistant' THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) ELSE 0 END AS output_tokens
           FROM conversations""",
    ),
    "entity": (
        "",
        """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) || ' '
             WHEN 2 THEN 'N-' || n_nationkey WHEN 3 THEN replace(n_name, 'TI', 'T')
             WHEN 4 THEN 'ZONE' || (c_custkey % 7) ELSE 'NATO' END AS entity
           FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "entity_list": (
        "entity",
        "SELECT id // 4 AS query_pos, list(entity ORDER BY id) AS entities FROM entity GROUP BY 1",
    ),
    "alias": (
        "",
        """SELECT lower(n_name) AS alias, n_name AS country, 0 AS priority FROM nation
           UNION ALL SELECT 'n-' || n_nationkey, n_name, 1 FROM nation""",
    ),
    "country_dim": (
        "",
        """SELECT n_name AS country, 'C' || n_nationkey AS alpha2, 'G' || (n_nationkey * 3) AS gkg_code,
             r_name AS region,
             CASE WHEN n_nationkey % 2 = 0 THEN [['en','fr','de','es','zh'][n_nationkey % 5 + 1]]
               ELSE [['en','fr','de','es','zh'][n_nationkey % 5 + 1], 'ar'] END AS languages
           FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "region_dim": ("", "SELECT 'zone' || r_regionkey AS region, ['pt', 'en'] AS languages FROM region"),
    "resolved": (
        "entity alias",
        """SELECT entity, coalesce(exact, fuzzy) AS country FROM (
             SELECT e.entity,
               (SELECT arg_min(country, priority) FROM alias WHERE alias.alias = lower(trim(e.entity))) AS exact,
               CASE WHEN length(trim(e.entity)) >= 3 THEN (SELECT arg_min(country, (-sim, country)) FROM (
                 SELECT DISTINCT country, 1.0::DOUBLE - levenshtein(lower(country), lower(trim(e.entity)))
                   / greatest(length(country), length(trim(e.entity)))::DOUBLE AS sim FROM alias) WHERE sim >= 0.75) END AS fuzzy
             FROM (SELECT DISTINCT entity FROM entity) e)""",
    ),
}


def with_views(body: str, names: list[str]) -> str:
    """Put the views a query needs, and those they need, in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = SQL_VIEWS[name]
        for dep in deps.split():
            add(dep)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in order]
    text = body.strip()
    if text[:5].upper() == "WITH ":
        own = text[5:].strip()
        if own[:10].upper() == "RECURSIVE ":
            own = own[10:]
        return "WITH RECURSIVE " + ",\n".join(parts + [own])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + text) if parts else text
