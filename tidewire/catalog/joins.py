"""Dimension joins, query expansion, history and contradiction joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.base import AS_OF, Tables, joined, query, r8
from tidewire.operators import expansion, resolve


@query("jn01_resolve_countries", "SELECT entity, country FROM resolved", "resolved")
def _(t: Tables):
    return resolve.resolve_countries(t.entity(), t.aliases())


@query(
    "jn01_normalize_rows",
    "SELECT e.id, e.entity, r.country FROM entity e LEFT JOIN resolved r ON r.entity = e.entity",
    "resolved",
)
def _(t: Tables):
    return resolve.normalize_countries(t.entity(), t.aliases()).select("id", "entity", "country")


@query(
    "jn01b_reject_acronyms",
    """SELECT entity, CASE WHEN regexp_matches(trim(entity), '^[A-Z]{2,}$') THEN NULL ELSE country END AS country FROM resolved""",
    "resolved",
)
def _(t: Tables):
    return resolve.resolve_countries(t.entity(), t.aliases(), reject_acronyms=True, min_len=3)


@query(
    "jn02_country_codes",
    "SELECT a.id, c.alpha2, c.gkg_code FROM article a LEFT JOIN country_dim c USING (country)",
    "article country_dim",
)
def _(t: Tables):
    return resolve.add_codes(t.article().select("id", "country"), t.countries()).select("id", "alpha2", "gkg_code")


@query(
    "jn02_code_to_country",
    """SELECT c_custkey AS id, 'NATION_' || c_nationkey AS country FROM customer""",
)
def _(t: Tables):
    rows = t.table("customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("alpha2")
    )
    return resolve.add_codes(rows, t.countries(), by="alpha2").select("id", "country")


_ENTITY_LANGS = """el AS (SELECT r.entity, coalesce(c.alpha2, r.entity) AS code, coalesce(c.languages, g.languages, []) AS languages
    FROM resolved r LEFT JOIN country_dim c ON c.country = r.country LEFT JOIN region_dim g ON g.region = lower(trim(r.entity)))"""


@query(
    "jn03_languages",
    f"""WITH {_ENTITY_LANGS},
      l AS (SELECT query_pos, unnest(languages) AS language FROM (SELECT query_pos, unnest(entities) AS entity FROM entity_list) JOIN el USING (entity)
        UNION SELECT query_pos, 'en' FROM entity_list),
      v AS (SELECT query_pos, language FROM l UNION SELECT query_pos, x.variant FROM l JOIN (VALUES ('zh', 'zh-CN'), ('zh', 'zh-TW'), ('zh', 'zh-HK')) x(language, variant) USING (language))
      SELECT query_pos, string_agg(language, '|' ORDER BY language) AS languages FROM v GROUP BY 1""",
    "entity_list resolved country_dim region_dim",
)
def _(t: Tables):
    got = resolve.languages_of_entities(
        t.entity_list(), "query_pos", t.aliases(), t.countries(), t.regions(), t.variants()
    )
    return got.withColumn("languages", joined("languages"))


@query(
    "jn03_entity_language_map",
    f"""WITH {_ENTITY_LANGS} SELECT query_pos, code, array_to_string(languages, ',') AS languages FROM (
        SELECT DISTINCT query_pos, code, languages FROM (SELECT query_pos, unnest(entities) AS entity FROM entity_list) JOIN el USING (entity))""",
    "entity_list resolved country_dim region_dim",
)
def _(t: Tables):
    got = resolve.entity_language_map(t.entity_list(), "query_pos", t.aliases(), t.countries(), t.regions())
    return got.select("query_pos", F.explode("entity_languages").alias("code", "l")).select(
        "query_pos", "code", F.array_join("l", ",").alias("languages")
    )


def _translations(t: Tables):
    """Lookup made of the pages of bilingual sources: every third article has a French text."""
    a = t.article().where("id % 3 = 0")
    return a.select(
        F.col("title").alias("text"), F.lit("fr").alias("language"), F.concat(F.lit("FR:"), "title").alias("translated")
    ).distinct()


@query(
    "jn04_expand_languages",
    """WITH q AS (SELECT id, title, unnest(CASE WHEN id % 2 = 0 THEN ['en', 'fr'] ELSE ['fr', 'uk', 'zh-CN'] END) AS language FROM article)
      SELECT q.id, q.language, CASE WHEN q.language IN ('en', 'uk') OR x.title IS NULL THEN q.title ELSE 'FR:' || q.title END AS query_translated,
        CASE WHEN length(q.language) > 2 THEN 'unsupported' WHEN q.language IN ('en', 'uk') THEN 'same' WHEN x.title IS NOT NULL THEN 'translated' ELSE 'failed' END AS status
      FROM q LEFT JOIN (SELECT DISTINCT title FROM article WHERE id % 3 = 0) x ON x.title = q.title AND q.language = 'fr'""",
    "article",
)
def _(t: Tables):
    langs = F.when(F.col("id") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(
        F.array(F.lit("fr"), F.lit("uk"), F.lit("zh-CN"))
    )
    q = t.article().select("id", F.col("title").alias("query"), langs.alias("languages"))
    return expansion.expand_languages(q, _translations(t)).select("id", "language", "query_translated", "status")


@query(
    "jn04_batch_translate",
    """SELECT a.id, CASE WHEN x.title IS NOT NULL THEN 'FR:' || a.title ELSE a.title END AS translated FROM article a
      LEFT JOIN (SELECT DISTINCT title FROM article WHERE id % 3 = 0) x ON x.title = a.title""",
    "article",
)
def _(t: Tables):
    rows = t.article().select("id", F.col("title").alias("text"))
    return expansion.batch_translate(rows, _translations(t), "fr").select("id", "translated")


@query(
    "jn05_entity_combinations",
    """WITH q AS (SELECT query_pos, entities, list_sort(list_distinct(list_filter(entities, lambda e: list_contains(al, lower(e))))) AS countries FROM entity_list, (SELECT list(alias) AS al FROM alias)),
      b AS (SELECT query_pos, entities, countries, unnest(range(1, 1 << len(entities))) AS bits FROM q WHERE len(countries) > 0 AND len(entities) >= 1),
      s AS (SELECT query_pos, bits, array_to_string(list_filter(entities, lambda e, i: (bits >> (i - 1)) & 1 = 1), ', ') AS keyword, unnest(countries) AS country FROM b),
      u AS (SELECT keyword, country, arg_min(query_pos, (query_pos, bits)) AS query_pos FROM s WHERE keyword <> country GROUP BY 1, 2),
      d AS (SELECT array_to_string(entities, ', ') AS keyword, min(query_pos) AS query_pos FROM q WHERE len(countries) > 0 AND len(entities) > 1 GROUP BY 1)
      SELECT query_pos, rpad(keyword, CAST(greatest(length(keyword), 5) AS INTEGER), ' ') AS keyword, country, '2024-01-30' AS start_date, '2024-01-31' AS end_date, 250 AS maxrecords FROM u
      UNION ALL SELECT query_pos, keyword, NULL, '2024-01-30', '2024-01-31', 250 FROM d""",
    "entity_list alias",
)
def _(t: Tables):
    q = t.entity_list()
    known = resolve.known_country_entities(q, "query_pos", t.aliases())
    return expansion.entity_combinations(q.join(known, "query_pos"), AS_OF).drop("entities")


@query(
    "jn06_related_articles",
    """SELECT h.id AS event_id, a.id AS article_id FROM (SELECT id, unnest(list_distinct(article_urls)) AS url FROM hotspot) h JOIN article a USING (url)""",
    "hotspot article",
)
def _(t: Tables):
    ev = t.hotspot().select(F.col("id").alias("event_id"), "article_urls")
    arts = t.article().select(F.col("id").alias("article_id"), "url")
    return resolve.related_articles(ev, arts).select("event_id", "article_id")


@query(
    "jn07_missing_articles",
    """SELECT id, string_agg(url, '|' ORDER BY url) AS missing_urls FROM (SELECT DISTINCT id, unnest(article_urls) AS url FROM hotspot)
      WHERE url NOT IN (SELECT url FROM article WHERE language <> 'fr') GROUP BY 1""",
    "hotspot article",
)
def _(t: Tables):
    got = resolve.missing_articles(t.hotspot(), t.article().where("language <> 'fr'"))
    return got.withColumn("missing_urls", joined("missing_urls"))


@query(
    "jn08_query_history",
    """SELECT b.item_id AS qid, a.id AS hid FROM (SELECT item_id, lower(text) AS q FROM benchmark
        UNION ALL SELECT 100000 + item_id, lower(split_part(text, ' ', 2)) FROM benchmark
        UNION ALL SELECT 200000 + item_id, lower(left(text, 30)) FROM benchmark
        UNION ALL SELECT 300000 + item_id, lower(substr(text, 3, 5)) FROM benchmark) b
      JOIN article a ON contains(lower(a.content), b.q) AND b.q <> ''""",
    "article",
)
def _(t: Tables):
    """All articles are the history."""
    text = F.col("text")
    # Whole passages, their second words, their beginnings and pieces that cut words.
    kinds = (text, F.split_part(text, F.lit(" "), F.lit(2)), F.left(text, F.lit(30)), F.substring(text, 3, 5))
    asked = F.array(*[F.struct((F.col("item_id") + 100000 * i).alias("qid"), q.alias("query")) for i, q in enumerate(kinds)])
    q = t.table("benchmark").select(F.inline(asked))
    h = t.article().select(F.col("id").alias("hid"), F.col("content").alias("query"))
    return resolve.query_history(q, h, hours=None)


@query(
    "jn09_contradictions",
    """SELECT a.event_id, a.claim_pos AS claim1, b.claim_pos AS claim2 FROM claim a JOIN claim b ON a.event_id = b.event_id AND a.claim_pos < b.claim_pos
      WHERE (a.verdict = 'true' AND b.verdict = 'false') OR (a.verdict = 'false' AND b.verdict = 'true') OR a.s = b.c""",
    "claim",
)
def _(t: Tables):
    return resolve.contradictions(t.claim())


@query(
    "jn10_children_of_flashpoint",
    """SELECT f.id AS flashpoint, e.id AS feed FROM flashpoint f JOIN feed e ON e.flashpoint_id = f.id WHERE f.language = 'en'""",
    "flashpoint feed",
)
def _(t: Tables):
    fp = t.flashpoint().where("language = 'en'").select(F.col("id").alias("flashpoint_id"))
    return t.feed().join(fp, "flashpoint_id").select(F.col("flashpoint_id").alias("flashpoint"), F.col("id").alias("feed"))


PRICED_SQL = """SELECT session, turn, input_tokens / 1000.0::DOUBLE * CASE model WHEN 'mistral-large' THEN 0.007 ELSE 0.01 END
    + output_tokens / 1000.0::DOUBLE * CASE model WHEN 'mistral-large' THEN 0.024 ELSE 0.03 END AS cost, input_tokens, output_tokens FROM usage"""


@query("jn11_priced_calls", f"SELECT session, turn, round(cost, 8) AS cost FROM ({PRICED_SQL})", "usage")
def _(t: Tables):
    from tidewire import fixed
    from tidewire.sources import dims

    priced = resolve.price_calls(t.usage(), dims.prices(t.spark), fixed.DEFAULT_PRICE)
    return priced.select("session", "turn", r8("cost").alias("cost"))


@query(
    "jn12_page_overlap",
    """WITH p AS (SELECT DISTINCT country AS run, pos // 250 AS page, url FROM article),
      f AS (SELECT run, url, min(page) AS first FROM p GROUP BY 1, 2)
      SELECT run, page, round(avg(CASE WHEN first < page THEN 1.0 ELSE 0.0 END), 8) AS overlap, avg(CASE WHEN first < page THEN 1.0 ELSE 0.0 END) > 0.5 AS skip
      FROM p JOIN f USING (run, url) GROUP BY 1, 2""",
    "article",
)
def _(t: Tables):
    pages = t.article().select(F.col("country").alias("run"), F.floor(F.col("pos") / 250).cast("long").alias("page"), "url")
    return resolve.page_overlap(pages, "run").withColumn("overlap", r8("overlap"))


@query(
    "jn13_missing_entities",
    """SELECT id, array_to_string(list_sort(list_distinct(list_filter(entities, lambda e: NOT list_contains(kept, e)))), '|') AS missing
      FROM (SELECT id, entities, entities[2:] AS kept FROM flashpoint)""",
    "flashpoint",
)
def _(t: Tables):
    kept = F.slice("entities", 2, F.greatest(F.size("entities") - 1, F.lit(0)))
    return t.flashpoint().select(
        "id", joined(F.array_sort(resolve.missing_entities(F.col("entities"), kept))).alias("missing")
    )


@query(
    "jn14_known_countries",
    """SELECT query_pos, string_agg(entity, '|' ORDER BY entity) AS countries FROM (SELECT DISTINCT query_pos, entity FROM (
        SELECT query_pos, unnest(entities) AS entity FROM entity_list) WHERE lower(entity) IN (SELECT alias FROM alias)) GROUP BY 1""",
    "entity_list alias",
)
def _(t: Tables):
    got = resolve.known_country_entities(t.entity_list(), "query_pos", t.aliases())
    return got.withColumn("countries", joined("countries"))


@query(
    "jn15_geo_entities",
    """SELECT query_pos, string_agg(entity, '|' ORDER BY entity) AS geo_entities FROM (SELECT DISTINCT query_pos, entity FROM (
        SELECT query_pos, unnest(entities) AS entity FROM entity_list) WHERE entity IN (SELECT entity FROM resolved WHERE country IS NOT NULL)) GROUP BY 1""",
    "entity_list resolved",
)
def _(t: Tables):
    got = resolve.geo_entities(t.entity_list(), "query_pos", t.aliases())
    return got.withColumn("geo_entities", joined("geo_entities"))
