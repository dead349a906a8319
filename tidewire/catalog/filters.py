"""Filters and projections over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.catalog.base import AS_OF, AS_OF_SQL, STAMP, Tables, any_sql, joined, query, r8, stamp
from tidewire.functions import records, text as tx, urls
from tidewire.operators import docquery as dq, filters as fl

W = tx.WORD
ALIKE = "doc_id AS id"


def _search(t: Tables, *conds, **kw):
    """Matching documents of the whole period, as ids."""
    kw.setdefault("timespan", "100d")
    kw.setdefault("max_records", None)
    return dq.search(t.article(), AS_OF, *conds, **kw).select("id")


@query(
    "flt01_valid_articles",
    f"""SELECT id FROM article WHERE length(trim(title)) >= 10 AND url <> '' AND published_at >= {AS_OF_SQL} - INTERVAL 12 DAY""",
    "article",
)
def _(t: Tables):
    return fl.valid_articles(t.article(), AS_OF, max_days=12).select("id")


_LINE = "regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s\\-.,!?]', '', 'g')"


@query(
    "flt02_clean_articles",
    f"""SELECT id, {_LINE.format('title')} AS title, {_LINE.format('description')} AS description,
        md5(trim(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) AS content_md5 FROM article""",
    "article",
)
def _(t: Tables):
    return fl.clean_articles(t.article()).select("id", "title", "description", F.md5("content").alias("content_md5"))


@query(
    "flt03_valid_items",
    """SELECT id, id % 5 <> 0 AND title <> '' AS valid, id % 5 <> 0 AND id % 7 <> 0 AND title <> '' AS valid_http FROM article""",
    "article",
)
def _(t: Tables):
    p = F.col("id")
    url = F.when(p % 5 == 0, "").when(p % 7 == 0, F.replace("url", F.lit("http://"), F.lit("ftp://"))).otherwise(F.col("url"))
    return t.article().withColumn("url", url).select(
        "id", fl.item_is_valid().alias("valid"), fl.item_is_valid(True).alias("valid_http")
    )


def _unified(t: Tables):
    a = t.article().select(
        "pos", "title", "url", "source", stamp("published_at").alias("published_date"),
        F.col("description").alias("snippet"),
    )
    e = t.events().select(
        F.col("event_id").alias("pos"), F.col("event_type").alias("title"),
        F.concat(F.lit("http://events.example.com/"), F.col("user_id").cast("string")).alias("url"),
        F.lit("events").alias("source"), stamp("ts").alias("published_date"),
    )
    return fl.unify(a, e)


@query(
    "flt04_unify",
    f"""SELECT 'article' AS type, pos, title, url, source, strftime(published_at, {STAMP}) AS published_date, description AS content FROM article
      UNION ALL SELECT 'event', event_id, event_type, 'http://events.example.com/' || user_id, 'events', strftime(ts, {STAMP}), event_type FROM events""",
    "article",
)
def _(t: Tables):
    return _unified(t)


@query(
    "flt05_standardize",
    """SELECT CAST(id AS VARCHAR) AS id, title, url, source, '' AS published_date, content, 'unknown' AS type,
        CASE WHEN id % 4 = 0 THEN 'content|id|title|url' ELSE 'content|id|source|title|url' END AS original_keys FROM (
      SELECT id, title, url, CASE WHEN id % 4 = 0 THEN '' ELSE source END AS source, content AS content FROM article)""",
    "article",
)
def _(t: Tables):
    src = F.when(F.col("id") % 4 != 0, F.col("source"))
    rows = t.article().select("id", "title", "url", src.alias("source"), F.col("content").alias("content"))
    return fl.standardize(rows).withColumn("original_keys", joined("original_keys"))


@query(
    "flt06_keyword",
    f"""SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(of the|nicht|dans les)($|[^\\p{{L}}\\p{{N}}_])')""",
)
def _(t: Tables):
    return _search(t, dq.keyword(F.col("content"), "of the; nicht ;dans les"))


@query(
    "flt07_domain",
    """SELECT page_id, contains(h, 'blog') AS inexact, h IN ('blog.ththan.example.net', 'spam-farm.example.org') AS exact
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)""",
)
def _(t: Tables):
    u = F.col("url")
    return t.table("pages").select(
        "page_id", dq.domain(u, "blog").alias("inexact"),
        dq.domain_exact(u, ["blog.ththan.example.net", "spam-farm.example.org"]).alias("exact"),
    )


@query(
    "flt08_country_language_theme",
    """SELECT id FROM processed WHERE country IN ('NATION_1', 'NATION_7', 'NATION_8') AND language IN ('en', 'fr') AND list_has_any(categories, ['alpha', 'delta'])""",
    "processed",
)
def _(t: Tables):
    return t.processed().where(
        dq.one_of(F.col("country"), ["NATION_1", "NATION_7", "NATION_8"])
        & dq.one_of(F.col("language"), ["en", "fr"])
        & dq.theme(F.col("categories"), ["alpha", "delta"])
    ).select("id")


@query(
    "flt09_tone",
    """SELECT id, sentiment > 0.25 AS above, sentiment < -0.5 AS below, abs(sentiment) > 0.8 AS strong FROM processed WHERE sentiment IS NOT NULL""",
    "processed",
)
def _(t: Tables):
    s = F.col("sentiment")
    return t.processed().where(s.isNotNull()).select(
        "id", dq.tone(s, ">0.25").alias("above"), dq.tone(s, "<-0.5").alias("below"),
        dq.tone(s, ">0.8", absolute=True).alias("strong"),
    )


_POS = f"""SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS ws FROM documents)"""


@query(
    "flt10_near",
    f"""WITH pos AS ({_POS})
      SELECT DISTINCT id FROM (
        SELECT a.doc_id AS id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND abs(a.p - b.p) <= 3 WHERE a.w = 'the' AND b.w = 'was'
        UNION ALL SELECT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id JOIN pos c ON a.doc_id = c.doc_id
          WHERE a.w = 'les' AND b.w = 'des' AND c.w = 'que' AND greatest(a.p, b.p, c.p) - least(a.p, b.p, c.p) <= 8)""",
)
def _(t: Tables):
    return _search(t, dq.multi_near(F.col("content"), [(3, "the", "was"), (8, "les", "des", "que")], "OR"))


@query(
    "flt11_repeat",
    f"""WITH pos AS ({_POS}) SELECT doc_id AS id FROM pos GROUP BY doc_id
      HAVING count_if(w = 'the') >= 5 AND count_if(w = 'of') >= 3""",
)
def _(t: Tables):
    return _search(t, dq.multi_repeat(F.col("content"), [(5, "the"), (3, "of")], "AND"))


@query(
    "flt12_date_range",
    f"""(SELECT id, 'range' AS mode FROM article WHERE published_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12')
      UNION ALL (SELECT id, 'span' FROM article WHERE published_at BETWEEN {AS_OF_SQL} - INTERVAL 2 DAY AND {AS_OF_SQL} ORDER BY published_at DESC, id LIMIT 25)""",
    "article",
)
def _(t: Tables):
    a = dq.search(
        t.article(), AS_OF, start_date=datetime(2024, 1, 10), end_date=datetime(2024, 1, 12), max_records=None
    )
    b = dq.search(t.article(), AS_OF, timespan="2d", max_records=25)
    return a.select("id", F.lit("range").alias("mode")).unionByName(b.select("id", F.lit("span").alias("mode")))


@query(
    "flt13_exclude_terms",
    f"""SELECT doc_id AS id FROM documents WHERE NOT {any_sql('lower(text)', ('thing', 'nicht', 'elle'))}""",
)
def _(t: Tables):
    return fl.without_terms(t.article(), F.col("content"), ["thing", "Nicht", "elle"]).select("id")


@query(
    "flt13_exclude_seen_words",
    f"""WITH seen AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM benchmark)
      SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (
        SELECT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) JOIN seen USING (term))""",
)
def _(t: Tables):
    words = tx.words_of(F.col("text"))
    seen = t.table("benchmark").select(F.explode(words).alias("term"))
    return fl.without_seen_words(t.article(), "id", F.col("content"), seen).select("id")


@query(
    "flt13_exclusion_text",
    """SELECT string_agg('-"' || e || '"', ' ' ORDER BY e) AS exclude_query FROM (SELECT DISTINCT lower(trim(entity)) AS e FROM entity)""",
    "entity",
)
def _(t: Tables):
    return fl.exclusion_text(t.entity().select(F.col("entity").alias("term")))


_URL_WORDS = ("utm_source", "blog", "page=", "spam-farm")


@query(
    "flt14_news_urls",
    f"SELECT page_id FROM pages WHERE {any_sql('lower(url)', _URL_WORDS)}",
)
def _(t: Tables):
    return fl.news_urls(t.table("pages"), _URL_WORDS).select("page_id")


def _subscriptions(t: Tables):
    """One subscription per user: a nation, a keyword and thresholds from its events."""
    u = F.col("user_id")
    return t.events().groupBy("user_id").agg(F.round(F.avg("value"), 2).alias("v")).select(
        F.col("user_id").alias("client"),
        F.when(u % 3 == 0, F.array(F.lit("alpha"), F.lit("gamma"))).alias("categories"),
        F.when(u % 2 == 0, F.array(F.concat(F.lit("NATION_"), (u % 25).cast("string")))).alias("countries"),
        F.when(u % 5 != 0, F.array(F.lit("tion"), F.lit("SCH"))).otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.when(u % 4 == 0, F.lit(0.5)).otherwise(0.0).alias("min_relevance"),
        F.lit(0.25).alias("min_quality"),
        F.when(u % 7 == 0, F.array(F.lit("en"))).alias("languages"),
    )


@query(
    "flt15_subscription_match",
    """SELECT a.id, s.client FROM processed a JOIN (SELECT DISTINCT user_id AS client FROM events) s ON
        (s.client % 3 <> 0 OR list_has_any(a.categories, ['alpha', 'gamma']))
        AND (s.client % 2 <> 0 OR contains(a.country, 'NATION_' || (s.client % 25)))
        AND (s.client % 5 = 0 OR contains(array_to_string(a.keywords, ' '), 'tion') OR contains(array_to_string(a.keywords, ' '), 'sch'))
        AND (s.client % 4 <> 0 OR a.relevance >= 0.5) AND a.quality >= 0.25
        AND (s.client % 7 <> 0 OR a.language = 'en')""",
    "processed",
)
def _(t: Tables):
    return fl.route_to_subscribers(t.processed(), _subscriptions(t)).select("id", F.col("sub_client").alias("client"))


@query(
    "flt16_stored_filters",
    f"""SELECT id, strftime(created_at, {STAMP}) AS created_at FROM flashpoint WHERE language = 'en' AND list_has_any(domains, ['alpha', 'delta'])
      ORDER BY flashpoint.created_at DESC, id LIMIT 40 OFFSET 10""",
    "flashpoint",
)
def _(t: Tables):
    rows = fl.stored(t.flashpoint(), {"language": "en"}, {"domains": ["alpha", "delta"]})
    return rows.orderBy(F.desc("created_at"), "id").offset(10).limit(40).select("id", stamp("created_at").alias("created_at"))


@query("flt17_unprocessed_children", "SELECT id, flashpoint_id FROM feed WHERE coalesce(content, '') = ''", "feed")
def _(t: Tables):
    return fl.unprocessed_children(t.feed())


@query(
    "flt18_max_age",
    f"SELECT id FROM article WHERE published_at >= {AS_OF_SQL} - INTERVAL 240 HOUR",
    "article",
)
def _(t: Tables):
    return fl.max_age(t.article(), AS_OF, 240).select("id")


@query(
    "flt19_flashpoint_valid",
    """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY array_to_string(list_sort(list_transform(entities, lambda e: lower(trim(e)))), ',') ORDER BY pos) AS r
        FROM flashpoint WHERE title <> '' AND description <> '' AND len(entities) BETWEEN 1 AND 3 AND list_has_any(entities, (SELECT list(n_name) FROM nation))) WHERE r = 1""",
    "flashpoint",
)
def _(t: Tables):
    from tidewire.operators import dedup, resolve

    fp = t.flashpoint().where(fl.flashpoint_fields_present() & fl.entity_count_between(1, 3))
    geo = resolve.geo_entities(fp, "id", t.aliases(), fuzzy_cutoff=None).select("id")
    return dedup.new_combos(fp.join(geo, "id", "left_semi")).select("id")


@query(
    "flt20_enough_entries",
    """SELECT DISTINCT flashpoint_id FROM feed WHERE flashpoint_id IN (SELECT flashpoint_id FROM feed WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 11)""",
    "feed",
)
def _(t: Tables):
    feed = t.feed()
    parents = feed.select("flashpoint_id").distinct()
    return fl.with_enough_children(parents, feed.where("content IS NOT NULL"), "flashpoint_id", 11)


@query(
    "flt21_query_text_valid",
    """SELECT id, length(q) BETWEEN 4 AND 300 AND regexp_matches(q, '[a-zA-Z]') AND NOT regexp_matches(q, '[;#{}<>]')
        AND len(regexp_split_to_array(q, '\\s+')) >= 2 AS valid
      FROM (SELECT id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS q FROM article)""",
    "article",
)
def _(t: Tables):
    return t.article().select("id", records.query_text_valid(F.col("title")).alias("valid"))


@query(
    "flt22_query_reply",
    """SELECT event_id, event_type AS query, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id END AS entities FROM events WHERE event_id % 10 <> 0
      UNION ALL SELECT event_id, 'second', '' FROM events WHERE event_id % 10 <> 1""",
)
def _(t: Tables):
    e = F.col("event_id")
    first = F.when(e % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    ents = F.when(e % 3 == 0, F.lit('" "')).otherwise(
        F.concat(F.lit('" u'), F.col("user_id").cast("string"), F.lit('", ""'))
    )
    second = F.when(e % 10 == 1, F.lit("")).otherwise(F.lit("second"))
    reply = F.concat(
        F.lit('[{"query":"'), first, F.lit('","entities":['), ents, F.lit(']},{"query":"'), second, F.lit('"}]')
    )
    rows = fl.clean_query_reply(t.events().select("event_id", reply.alias("reply")))
    return rows.withColumn("entities", joined("entities"))


@query(
    "flt23_time_modifier",
    "SELECT id, CASE WHEN contains(lower(q), 'news') THEN q || ' when:1d' ELSE q END AS query FROM (SELECT id, CASE WHEN id % 3 = 0 THEN source || ' News' ELSE source END AS q FROM article)",
    "article",
)
def _(t: Tables):
    q = F.when(F.col("id") % 3 == 0, F.concat("source", F.lit(" News"))).otherwise(F.col("source"))
    return t.article().select("id", records.with_time_modifier(q).alias("query"))


@query(
    "flt24_search_errors",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Missing field: end_date'
        WHEN 2 THEN 'Keyword list must contain at least one non-empty keyword.|start_date must be in YYYY-MM-DD format.'
        WHEN 3 THEN 'end_date cannot be earlier than start_date.' ELSE 'maxrecords must be an integer between 1 and 1000.' END AS errors FROM events""",
)
def _(t: Tables):
    k = F.col("event_id") % 5
    day = F.date_format("ts", "yyyy-MM-dd")
    errs = records.search_errors(
        F.when(k == 2, " , ").otherwise(F.col("event_type")),
        F.when(k == 2, "01/02/2024").when(k == 3, "2024-12-31").otherwise(day),
        F.when(k == 1, F.lit(None)).when(k == 3, day).otherwise(F.lit("2024-12-30")),
        F.when(k == 4, 5000).otherwise(250),
    )
    return t.events().select("event_id", joined(errs).alias("errors"))


@query(
    "flt25_route_for_translation",
    """SELECT language, count(*) AS n, count_if(language <> 'en' AND language <> 'unknown') AS to_translate FROM (
        SELECT CASE WHEN id % 9 = 0 THEN 'unknown' ELSE language END AS language FROM article) GROUP BY 1""",
    "article",
)
def _(t: Tables):
    lang = F.when(F.col("id") % 9 == 0, "unknown").otherwise(F.col("language"))
    rows = t.article().select(lang.alias("language"))
    return rows.groupBy("language").agg(
        F.count("*").alias("n"), F.count_if(tx.needs_translation(F.col("language"))).alias("to_translate")
    )


@query(
    "flt26_recent_hotspots",
    f"SELECT id FROM hotspot WHERE created_at >= {AS_OF_SQL} - INTERVAL 7 DAY ORDER BY created_at DESC, id LIMIT 30",
    "hotspot",
)
def _(t: Tables):
    return fl.recent(t.hotspot(), AS_OF, 7, 30).select("id")


@query(
    "flt27_decisions",
    """SELECT f.id, coalesce(l.quality = 1, false) AS approved FROM flashpoint f LEFT JOIN labels l ON l.doc_id = f.id""",
    "flashpoint",
)
def _(t: Tables):
    decision = F.when(F.col("quality") == 1, " Yes").otherwise("no")
    decisions = t.table("labels").select(F.col("doc_id").alias("id"), decision.alias("decision"))
    yes, no = fl.split_by_decision(t.flashpoint().select("id"), decisions, "id")
    return yes.withColumn("approved", F.lit(True)).unionByName(no.withColumn("approved", F.lit(False)))


@query("flt28_by_id", "SELECT id, title FROM article WHERE id = 77", "article")
def _(t: Tables):
    return fl.by_id(t.article(), 77).select("id", "title")


@query(
    "set02_url_difference",
    "SELECT DISTINCT url FROM article WHERE url NOT IN (SELECT unnest(article_urls) FROM hotspot)",
    "article hotspot",
)
def _(t: Tables):
    named = t.hotspot().select(F.explode("article_urls").alias("url"))
    return t.article().select("url").distinct().join(named, "url", "left_anti")


@query(
    "set01_union_sources",
    "SELECT type, count(*) AS n FROM (SELECT 'article' AS type FROM documents UNION ALL SELECT 'event' FROM events) GROUP BY 1",
)
def _(t: Tables):
    return _unified(t).groupBy("type").agg(F.count("*").alias("n"))
