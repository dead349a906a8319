"""Sources and sinks: files are written from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.base import AS_OF, AS_OF_SQL, STAMP, Tables, joined, query, stamp
from tidewire.functions.dates import parse_seen
from tidewire.operators.filters import max_age
from tidewire.operators.scans import top_k
from tidewire.plans import daily
from tidewire.session import shared_folder
from tidewire.sources import dims, landed, sinks
from tidewire.sources.keyed import KeyedTable


def _rss_items(t: Tables):
    """Items of one feed per source and language."""
    a = t.article()
    return a.select(
        F.concat("source", F.lit("-"), "language").alias("channel"), "pos",
        F.concat(F.lit("t"), F.col("pos").cast("string"), F.lit(" & <b>")).alias("title"),
        F.concat("source", F.lit(" text")).alias("description"),
        F.col("url").alias("link"),
        F.when(F.col("pos") % 9 != 0, F.concat(F.date_format("published_at", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("pubDate"),
        F.when(F.col("pos") % 4 != 0, F.col("source")).alias("source"),
    )


def _land_rss(t: Tables) -> str:
    """RSS files, one per feed: the items of a feed are one sorted partition of its folder."""
    path = shared_folder(t.spark, "rss")
    (
        _rss_items(t)
        .repartition("channel")
        .sortWithinPartitions("channel", "pos")
        .write.partitionBy("channel")
        .format("xml")
        .option("rootTag", "channel")
        .option("rowTag", "item")
        .save(path)
    )
    return path


@query(
    "src01_rss_articles",
    f"""SELECT title, url, source, strftime(published_at, {STAMP}) AS published_at, language, country, category FROM (
      SELECT 't' || pos || ' & <b>' AS title, url, CASE WHEN pos % 4 <> 0 THEN source ELSE 'Google News' END AS source,
        CASE WHEN pos % 9 <> 0 THEN published_at ELSE {AS_OF_SQL} END AS published_at, 'en' AS language, 'US' AS country, 'geopolitics' AS category,
        row_number() OVER (PARTITION BY source, language ORDER BY pos) AS r FROM article) WHERE r <= 15""",
    "article",
)
def _(t: Tables):
    rows = landed.read_rss(t.spark, _land_rss(t), AS_OF, per_feed=15)
    return rows.select("title", "url", "source", stamp("published_at").alias("published_at"), "language", "country", "category")


def _entries(t: Tables):
    """Article-list entries, ten per landed document."""
    p = F.col("pos")
    return t.article().select(
        "pos",
        F.when(p % 10 == 3, F.lit("unknown")).otherwise(F.date_format("published_at", "yyyyMMddHHmmss")).alias("seendate"),
        "url", "title", F.concat("source", F.lit(".example.com")).alias("domain"),
        F.when(F.col("language") == "en", "English").when(F.col("language") == "fr", "French").otherwise(F.col("language")).alias("language"),
        F.col("country").alias("sourcecountry"), F.lit("http://img/x").alias("socialimage"),
        (p % 7).cast("int").alias("nummentions"), ((p % 21) / 10.0 - 1).alias("avgtone"),
        F.array(F.create_map(F.lit("id"), p.cast("string"))).alias("mentions"),
    )


def _land_article_lists(t: Tables) -> str:
    path = shared_folder(t.spark, "artlist")
    rows = _entries(t)
    fields = [c for c in rows.columns if c != "pos"]
    (
        rows.groupBy(F.floor(F.col("pos") / 10).alias("doc"))
        .agg(F.collect_list(F.struct("pos", F.struct(*fields).alias("a"))).alias("l"))
        .withColumn("l", F.array_sort("l", lambda x, y: (x["pos"] - y["pos"]).cast("int")))
        .select(F.transform("l", lambda s: s["a"]).alias("articles"))
        .write.json(path)
    )
    return path


@query(
    "src02_article_list_events",
    f"""SELECT strftime(published_at, '%Y%m%d%H%M%S') AS event_id, strftime(published_at, {STAMP}) AS event_time, url AS source_url, CAST(pos % 7 AS INTEGER) AS num_mentions,
        round(pos % 21 / 10.0 - 1, 6) AS avg_tone, CAST(pos AS VARCHAR) AS first_mention FROM article WHERE pos % 10 <> 3""",
    "article",
)
def _(t: Tables):
    ev = landed.article_list_events(landed.read_article_list(t.spark, _land_article_lists(t)))
    return ev.select(
        "event_id", stamp("event_time").alias("event_time"), "source_url", "num_mentions",
        F.round("avg_tone", 6).alias("avg_tone"), F.col("mentions")[0]["id"].alias("first_mention"),
    )


@query(
    "src03_timeline_wide",
    """SELECT day AS datetime, max(n) FILTER (event_type = 'click')::DOUBLE AS click, max(n) FILTER (event_type = 'view')::DOUBLE AS "view", max(norm) AS all_articles FROM (
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')) AS norm FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(t: Tables):
    path = shared_folder(t.spark, "timeline")
    day = F.date_format("ts", "yyyy-MM-dd").alias("date")
    n = t.events().groupBy("event_type", day).agg(F.count("*").cast("double").alias("value"))
    norm = t.events().groupBy(day).agg(F.count("*").alias("norm"))
    series = n.join(norm, "date").groupBy(F.col("event_type").alias("series")).agg(
        F.array_sort(F.collect_list(F.struct("date", "value", "norm"))).alias("data")
    )
    series.select(F.array(F.struct("series", "data")).alias("timeline")).write.json(path)
    wide = landed.wide_timeline(landed.read_timeline(t.spark, path), ["click", "view"], with_norm=True)
    return wide.select("datetime", "click", "view", F.col("All Articles").alias("all_articles"))


@query(
    "src04_article_list_projection",
    """SELECT title, url, 'http://img/x' AS image, CASE WHEN pos % 10 = 3 THEN 'unknown' ELSE strftime(published_at, '%Y%m%d%H%M%S') END AS seen_date, source || '.example.com' AS domain,
        CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE language END AS language, country FROM article""",
    "article",
)
def _(t: Tables):
    return landed.article_list_projection(_entries(t))


@query(
    "src05_article_list_feed",
    f"""SELECT url, title, CASE WHEN pos % 10 = 3 THEN '' ELSE strftime(published_at, '%Y-%m-%d') END AS seendate, source || '.example.com' AS domain, language, country AS sourcecountry, title AS description, 'http://img/x' AS image
      FROM article WHERE pos % 10 = 3 OR published_at >= {AS_OF_SQL} - INTERVAL 10 DAY""",
    "article",
)
def _(t: Tables):
    return landed.article_list_feed(landed.article_list_projection(_entries(t)), AS_OF, days=10)


@query(
    "src06_rss_feed",
    f"""WITH f AS (SELECT *, 'https://n.example.com/rss?q=' || (id % 300) || '&hl=' || language AS feed_url FROM article)
      SELECT feed_url, url, title, CASE WHEN pos % 9 = 0 THEN '' ELSE strftime(published_at, '%Y-%m-%d') END AS seendate, language, description FROM f
      WHERE feed_url IN (SELECT feed_url FROM f GROUP BY 1 HAVING count(*) >= 2) AND (pos % 9 = 0 OR published_at >= {AS_OF_SQL} - INTERVAL 10 DAY)""",
    "article",
)
def _(t: Tables):
    a = t.article()
    feed = F.concat(F.lit("https://n.example.com/rss?q="), (F.col("id") % 300).cast("string"), F.lit("&hl="), "language")
    pub = F.when(F.col("pos") % 9 != 0, F.concat(F.date_format("published_at", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    items = a.select(feed.alias("feed_url"), F.col("url").alias("link"), "title", "description", pub.alias("pubDate"))
    return landed.rss_feed(items, AS_OF, days=10)


_PAGE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "src07_page_text",
    f"SELECT page_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT page_id, {_PAGE} AS t FROM pages) WHERE length(t) > 400",
)
def _(t: Tables):
    got = landed.page_texts(t.table("pages"), 400)
    return got.select("page_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


@query(
    "src08_gather_context",
    """SELECT query, count(*) AS n, md5(string_agg(trim(text), chr(10) || chr(10) ORDER BY pos)) AS context_md5 FROM (
        SELECT source || '-' || language AS query, pos, content AS text, row_number() OVER (PARTITION BY source, language ORDER BY pos) AS r FROM article) WHERE r <= 10 AND length(trim(text)) >= 100 GROUP BY 1""",
    "article",
)
def _(t: Tables):
    rows = t.article().select(F.concat("source", F.lit("-"), "language").alias("query"), "pos", F.col("content").alias("text"))
    return landed.gather_context(rows).select("query", "n", F.md5("context").alias("context_md5"))


@query(
    "src09_reference_data",
    """SELECT a.id, CASE language WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'es' THEN 'spa_Latn' ELSE 'eng_Latn' END AS model_code,
        CASE language WHEN 'fr' THEN 4 WHEN 'de' THEN 4 WHEN 'es' THEN 5 ELSE 11 END AS countries FROM article a""",
    "article",
)
def _(t: Tables):
    spoken = dims.countries(t.spark).select(F.explode("languages").alias("language")).groupBy("language").agg(
        F.count("*").alias("countries")
    )
    rows = t.article().select("id", "language")
    return rows.join(dims.model_codes(t.spark), "language", "left").join(spoken, "language", "left").select(
        "id", "model_code", "countries"
    )


def _store_feed_days(t: Tables) -> str:
    path = shared_folder(t.spark, "feeds")
    feed = t.feed().withColumn("dt", F.to_date("created_at"))
    sinks.replace_day(feed.hint("rebalance", "dt"), path)
    return path


@query(
    "src10_read_day",
    "SELECT id, 'feed_entries_20240107' AS table_name FROM feed WHERE CAST(created_at AS DATE) = DATE '2024-01-07'",
    "feed",
)
def _(t: Tables):
    rows = landed.read_day(t.spark, _store_feed_days(t), "2024-01-07")
    return rows.select("id", landed.day_table_name("feed_entries", F.col("dt")).alias("table_name"))


def _flashpoint_files(t: Tables) -> str:
    path = shared_folder(t.spark, "flashpoints")
    fp = t.flashpoint().select("id", "title", "description", "entities", "domains")
    sinks.write_json_per_key(fp.withColumn("block", F.col("id") % 16), path, "block")
    return path


@query(
    "src11_read_flashpoints",
    "SELECT title, md5(description) AS description_md5, array_to_string(entities, '|') AS entities FROM flashpoint",
    "flashpoint",
)
def _(t: Tables):
    # The files hold one object per line, so they are read without multiLine here.
    rows = t.spark.read.schema(landed.FLASHPOINT_SCHEMA).json(_flashpoint_files(t))
    return rows.select("title", F.md5("description").alias("description_md5"), joined("entities").alias("entities"))


@query(
    "snk01_daily_replace",
    """SELECT 'parent' AS kind, sha256('run-1|' || id) AS id, trim(title) AS title, 0 AS n FROM flashpoint WHERE trim(title) <> ''
      UNION ALL SELECT 'child', sha256(sha256('run-1|' || f.id) || '|' || e.url), trim(f.title), count(*) FROM flashpoint f JOIN feed e ON e.flashpoint_id = f.id WHERE trim(f.title) <> '' GROUP BY f.id, f.title, e.url""",
    "flashpoint feed",
)
def _(t: Tables):
    fp = t.flashpoint().where("trim(title) <> ''").withColumnRenamed("id", "flashpoint_id")
    entries = t.feed().select(
        "flashpoint_id", "url", "title", "domain", "language",
        F.lit("2024-01-31").alias("seendate"), F.lit("").alias("sourcecountry"), F.lit("").alias("description"),
    )
    path = shared_folder(t.spark, "day")
    for _ in range(2):  # the second run replaces the first
        out = daily.store_day(fp, entries, "run-1", AS_OF, path)
    parents, children = t.spark.read.parquet(out["flashpoint"]), t.spark.read.parquet(out["feed"])
    names = parents.select(F.col("id").alias("flashpoint_id"), F.col("title").alias("parent_title"))
    return parents.select(F.lit("parent").alias("kind"), "id", "title", F.lit(0).cast("long").alias("n")).unionByName(
        children.join(names, "flashpoint_id").groupBy("id", F.col("parent_title").alias("title")).agg(F.count("*").alias("n"))
        .select(F.lit("child").alias("kind"), "id", "title", "n")
    )


@query(
    "snk02_append_counted",
    "SELECT CAST(created_at AS DATE)::VARCHAR AS dt, count(*) AS n, (SELECT count(*) FROM feed) AS written FROM feed GROUP BY 1",
    "feed",
)
def _(t: Tables):
    path = shared_folder(t.spark, "append")
    n = sinks.append_counted(t.feed().withColumn("dt", F.to_date("created_at")), path)
    back = t.spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"))
    return back.withColumn("written", F.lit(n).cast("long"))


@query("snk03_json_per_flashpoint", "SELECT id % 16 AS block, count(*) AS n FROM flashpoint GROUP BY 1", "flashpoint")
def _(t: Tables):
    rows = t.spark.read.schema(landed.FLASHPOINT_SCHEMA + ", block long").json(_flashpoint_files(t))
    return rows.groupBy("block").agg(F.count("*").alias("n"))


_BASE_COLS = ("id", "title", "summary", "updated_at")


@query(
    "snk04_apply_changes",
    f"""SELECT id, CASE WHEN id % 5 = 1 THEN 'new title' ELSE title END AS title, summary, strftime(CASE WHEN id % 5 = 1 THEN {AS_OF_SQL} ELSE created_at END, {STAMP}) AS updated_at FROM hotspot WHERE id % 5 <> 0
      UNION ALL SELECT 1000000 + id, title, NULL, strftime({AS_OF_SQL}, {STAMP}) FROM hotspot WHERE id % 5 = 2""",
    "hotspot",
)
def _(t: Tables):
    base, changes = _changes(t)
    kept = KeyedTable(t.spark, shared_folder(t.spark, "keyed"), ["id"], base.schema)
    kept.change(0, base, lambda old, rows: rows)
    kept.change(1, changes, lambda old, rows: sinks.apply_changes(old, rows, AS_OF))
    return kept.read().withColumn("updated_at", stamp("updated_at"))


def _changes(t: Tables):
    h = t.hotspot().select("id", "title", "summary", F.col("created_at").alias("updated_at"))
    none = F.lit(None).cast("string")
    k = F.col("id") % 5
    up = h.where(k == 1).select("id", F.lit("new title").alias("title"), none.alias("summary"), "updated_at", F.lit("upsert").alias("op"))
    new = h.where(k == 2).select((F.col("id") + 1000000).alias("id"), "title", none.alias("summary"), "updated_at", F.lit("upsert").alias("op"))
    gone = h.where(k == 0).select("id", none.alias("title"), none.alias("summary"), "updated_at", F.lit("delete").alias("op"))
    return h, up.unionByName(new).unionByName(gone)


@query(
    "snk04_change_results",
    "SELECT id, 'upsert' AS op, true AS matched FROM hotspot WHERE id % 5 = 1 UNION ALL SELECT 1000000 + id, 'upsert', false FROM hotspot WHERE id % 5 = 2 UNION ALL SELECT id, 'delete', true FROM hotspot WHERE id % 5 = 0",
    "hotspot",
)
def _(t: Tables):
    return sinks.change_results(*_changes(t))


def _kinds(t: Tables):
    kind = F.when(F.col("pos") % 2 == 0, "log").otherwise("article")
    return t.article().select("id", kind.alias("kind"), F.col("published_at").alias("created_at"))


@query(
    "snk05_retention",
    f"""SELECT kind, count_if((kind = 'log' AND created_at < {AS_OF_SQL} - INTERVAL 10 DAY) OR (kind = 'article' AND created_at < {AS_OF_SQL} - INTERVAL 20 DAY)) AS removed, count(*) AS total,
        count_if(NOT ((kind = 'log' AND created_at < {AS_OF_SQL} - INTERVAL 10 DAY) OR (kind = 'article' AND created_at < {AS_OF_SQL} - INTERVAL 20 DAY))) AS kept
      FROM (SELECT CASE WHEN pos % 2 = 0 THEN 'log' ELSE 'article' END AS kind, published_at AS created_at FROM article) GROUP BY 1""",
    "article",
)
def _(t: Tables):
    days = {"log": 10, "article": 20}
    kept = sinks.retained(_kinds(t), AS_OF, days).groupBy("kind").agg(F.count("*").alias("kept"))
    return sinks.removed_counts(_kinds(t), AS_OF, days).join(kept, "kind")


@query(
    "snk06_audit_log",
    f"""SELECT pos, strftime(ts, '%Y-%m-%d') AS dt, run_id, agent, '[REDACTED]' AS token, props AS body, status FROM agent_log""",
    "agent_log",
)
def _(t: Tables):
    params = F.create_map(F.lit("auth_token"), F.col("agent"), F.lit("body"), F.col("props"))
    result = F.create_map(F.lit("status"), F.col("status"))
    logs = t.agent_log().withColumns({"params": params, "result": result})
    path = shared_folder(t.spark, "audit")
    sinks.audit_rows(logs, keep=("pos",)).write.partitionBy("dt").parquet(path)
    return t.spark.read.parquet(path).select(
        "pos", F.col("dt").cast("string").alias("dt"), "run_id", "agent",
        F.col("input")["auth_token"].alias("token"), F.col("input")["body"].alias("body"), F.col("output")["status"].alias("status"),
    )


@query(
    "snk06_run_summary",
    f"SELECT run_id, count(*) AS actions, count_if(status <> 'success') AS failed, round(sum(execution_time), 6) AS total_time, strftime(min(ts), {STAMP}) AS started_at, strftime(max(ts), {STAMP}) AS finished_at FROM agent_log GROUP BY 1",
    "agent_log",
)
def _(t: Tables):
    got = sinks.run_summary(t.agent_log())
    return got.withColumns(
        {"total_time": F.round("total_time", 6), "started_at": stamp("started_at"), "finished_at": stamp("finished_at")}
    )


@query(
    "udf02_custom_sources",
    "SELECT source_name, count(*) AS n FROM (SELECT 'docs' AS source_name FROM documents UNION ALL SELECT 'pages' FROM pages) GROUP BY 1",
)
def _(t: Tables):
    reg = landed.SourceRegistry()
    reg.add("docs", lambda s: t.article().select("title", "url", "source", "published_at"))
    reg.add(
        "pages",
        lambda s: t.table("pages").select(
            F.lit("").alias("title"), "url", F.lit("web").alias("source"), F.lit(AS_OF).alias("published_at"), "page_id"
        ),
    )
    return reg.read_all(t.spark).groupBy("source_name").agg(F.count("*").alias("n"))


@query(
    "udf03_process_stages",
    f"""SELECT id, quality FROM (SELECT id, round((CASE WHEN length(t) > 20 THEN 0.2 ELSE 0 END)::DOUBLE + CASE WHEN length(d) > 50 THEN 0.2 ELSE 0 END, 8) AS quality FROM (
      SELECT id, regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s\\-.,!?]', '', 'g') AS t,
        regexp_replace(trim(regexp_replace(description, '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s\\-.,!?]', '', 'g') AS d FROM article
      WHERE length(trim(title)) >= 10 AND published_at >= {AS_OF_SQL} - INTERVAL 30 DAY))""",
    "article",
)
def _(t: Tables):
    """Quality without its entity part, so that the check stays short."""
    from tidewire.plans.processing import process_articles

    got = process_articles(t.article(), AS_OF, ("validation", "cleaning", "enrichment", "analysis"))
    part = F.col("quality") - F.when(F.size("entities") > 5, 0.2).otherwise(0.0)
    return got.select("id", F.round(part, 8).alias("quality"))


@query("udf03_all_stages")
def _(t: Tables):
    from tidewire.plans.processing import process_articles

    return process_articles(t.article(), AS_OF).select("id", "relevance", "quality")


@query("udf04_scorer_hook", "SELECT id, length(title) > 40 AS decision FROM article", "article")
def _(t: Tables):
    from tidewire.plans.processing import score_with

    def judge(batches):
        for rows in batches:
            yield rows[["id"]].assign(decision=rows["title"].str.len() > 40)

    return score_with(t.article().select("id", "title"), judge, "id long, decision boolean")
