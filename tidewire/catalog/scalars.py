"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed
from tidewire.catalog.base import (
    AS_OF, AS_OF_SQL, CATS, RELEVANT_CATS, RELEVANT_WORDS, STAMP, TITLE_CASE_SQL, Tables, any_sql,
    STOP_SQL, categories_sql, joined, query, r8, stamp, tokens_sql,
)
from tidewire.functions import dates, records, scores, text as tx, urls

PROP_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "scl01_sanitize_text",
    """SELECT id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS short FROM (
      SELECT doc_id AS id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS t
      FROM documents)""",
)
def _(t: Tables):
    return t.table("documents").select(F.col("doc_id").alias("id"), tx.sanitize(F.col("text"), 80).alias("short"))


@query(
    "scl02_article_id",
    """SELECT id, left(sha256(url || title || strftime(published_at, '%Y-%m-%d %H:%M:%S')), 16) AS article_id FROM article""",
    "article",
)
def _(t: Tables):
    return t.article().select(
        "id", records.article_id(F.col("url"), F.col("title"), F.col("published_at")).alias("article_id")
    )


def _date_texts(t: Tables):
    e = F.col("event_id")
    fmt = lambda p: F.date_format("ts", p)
    return t.events().select(
        "event_id",
        F.when(e % 6 == 0, fmt("yyyyMMdd'T'HHmmss'Z'"))
        .when(e % 6 == 1, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(e % 6 == 2, fmt("yyyy-MM-dd'T'HH:mm:ss"))
        .when(e % 6 == 3, fmt("yyyy-MM-dd"))
        .when(e % 6 == 4, fmt("yyyyMMddHHmmss"))
        .otherwise(F.lit("garbage"))
        .alias("seen"),
    )


@query(
    "scl03_seen_date",
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def _(t: Tables):
    return _date_texts(t).select("event_id", dates.seen_date(F.col("seen")).alias("day"))


@query("scl04_rfc822_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(t: Tables):
    text = F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return t.events().select("event_id", dates.rfc822_date(text).alias("day"))


@query(
    "scl05_api_date",
    """SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS from_ts, strftime(ts, '%Y%m%d') || '000000' AS from_day FROM events""",
)
def _(t: Tables):
    return t.events().select(
        "event_id",
        dates.api_date(F.col("ts")).alias("from_ts"),
        dates.api_date_text(F.date_format("ts", "yyyy-MM-dd")).alias("from_day"),
    )


@query(
    "scl06_json_list",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n,
         CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || '|' || user_id END AS items FROM events""",
)
def _(t: Tables):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('["'), "event_type", F.lit('","'), F.col("user_id").cast("string"), F.lit('"]'))
    )
    got = t.events().select("event_id", records.json_list(text).alias("l"))
    return got.select("event_id", F.size("l").cast("long").alias("n"), joined("l").alias("items"))


@query(
    "scl07_tolerant_json",
    f"""SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE {PROP_K} END AS k FROM events""",
)
def _(t: Tables):
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(e % 6 == 0, F.col("props"))
        .when(e % 6 == 1, F.concat(F.lit("Here is the answer:\n"), "props"))
        .when(e % 6 == 2, F.concat(F.lit('{"k": '), k, F.lit(",}")))
        .when(e % 6 == 3, F.concat(F.lit("{k: "), k, F.lit("}")))
        .when(e % 6 == 4, F.concat(F.lit("{'k': "), k, F.lit("} thanks")))
        .otherwise(F.lit("nothing here"))
    )
    return t.events().select(
        "event_id", F.variant_get(records.tolerant_json(text), "$.k", "bigint").alias("k")
    )


_CODES = ", ".join(f"('{a}', '{b}')" for a, b in fixed.LANGUAGE_CODES.items())
_NAMES = ", ".join(f"('{a}', '{b}')" for a, b in fixed.LANGUAGE_NAMES.items())


@query(
    "scl08_language_code",
    f"""SELECT id, coalesce(c.code, lower(raw)) AS code, coalesce(n.name, 'Unknown') AS name FROM (
      SELECT id, CASE id % 3 WHEN 0 THEN upper(language) WHEN 1 THEN
        CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END
        ELSE 'Xx' END AS raw FROM article) a
      LEFT JOIN (VALUES {_CODES}) c(raw_name, code) ON c.raw_name = lower(a.raw)
      LEFT JOIN (VALUES {_NAMES}) n(code, name) ON n.code = coalesce(c.code, lower(raw))""",
    "article",
)
def _(t: Tables):
    named = (
        F.when(F.col("language") == "en", "English").when(F.col("language") == "fr", "French")
        .when(F.col("language") == "de", "German").otherwise("Spanish")
    )
    raw = F.when(F.col("id") % 3 == 0, F.upper("language")).when(F.col("id") % 3 == 1, named).otherwise("Xx")
    coded = t.article().select("id", tx.language_code(raw).alias("code"))
    return coded.withColumn("name", tx.language_name(F.col("code")))


@query(
    "scl09_feed_language",
    """SELECT id, CASE id % 3 WHEN 0 THEN language WHEN 1 THEN language ELSE NULL END AS lang FROM article""",
    "article",
)
def _(t: Tables):
    k = F.col("id") % 3
    url = (
        F.when(k == 0, F.concat(F.lit("https://n.example.com/rss?q=a+b&hl="), "language", F.lit("-XX&x=1")))
        .when(k == 1, F.concat(F.lit("https://n.example.com/rss?q=a&ceid=US:"), "language"))
        .otherwise(F.lit("https://n.example.com/rss?q=a"))
    )
    return t.article().select("id", urls.feed_language(url).alias("lang"))


@query(
    "scl10_feed_url",
    """SELECT id, 'https://news.google.com/rss/search?q=' || replace(source || ' a/b', ' ', '+').replace('/', '%2F')
        || '&hl=' || language || CASE WHEN language IN ('en', 'fr') THEN '&ceid=' ||
          CASE language WHEN 'en' THEN 'GB' ELSE 'FR' END || ':' || upper(language) ELSE '' END AS url
      FROM article""",
    "article",
)
def _(t: Tables):
    known = F.create_map(
        F.lit("gb"), F.array(F.lit("en")), F.lit("fr"), F.array(F.lit("fr"), F.lit("en"))
    )
    country = urls.country_for_language(F.col("language"), known)
    text = F.concat("source", F.lit(" a/b "))
    return t.article().select("id", urls.feed_url(text, F.col("language"), country).alias("url"))


@query(
    "scl11_url_well_formed",
    """SELECT page_id, regexp_matches(u, '^[a-z]+://[^/?#]+') AS ok FROM (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, 'https://', ''), 'http://', '')
        WHEN 2 THEN 'mailto:x' ELSE url END AS u FROM pages)""",
)
def _(t: Tables):
    k = F.col("page_id") % 4
    u = (
        F.when(k == 1, F.regexp_replace("url", "https?://", ""))
        .when(k == 2, F.lit("mailto:x")).otherwise(F.col("url"))
    )
    return t.table("pages").select("page_id", urls.well_formed(u).alias("ok"))


@query(
    "scl12_keywords",
    f"""SELECT d.doc_id AS id, coalesce(string_agg(k.w, '|' ORDER BY k.p), '') AS keywords
      FROM documents d LEFT JOIN (
        SELECT doc_id, w, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
          SELECT doc_id, w, min(p) AS p FROM (
            SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
            FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.WORD}') AS ws FROM documents))
          WHERE length(w) > 3 AND w NOT IN ({STOP_SQL}) GROUP BY 1, 2)) k
        ON k.doc_id = d.doc_id AND k.r <= 10
      GROUP BY 1""",
)
def _(t: Tables):
    return t.table("documents").select(
        F.col("doc_id").alias("id"), joined(tx.keywords(F.col("text"))).alias("keywords")
    )


@query(
    "scl13_categories",
    f"SELECT doc_id AS id, array_to_string({categories_sql('text')}, '|') AS categories FROM documents",
)
def _(t: Tables):
    return t.table("documents").select(
        F.col("doc_id").alias("id"), joined(tx.categories(F.col("text"), CATS)).alias("categories")
    )


@query(
    "scl13_categories_default",
    "SELECT doc_id AS id, array_to_string("
    + categories_sql("text", fixed.CATEGORY_WORDS)
    + ", '|') AS categories FROM documents",
)
def _(t: Tables):
    return t.table("documents").select(
        F.col("doc_id").alias("id"), joined(tx.categories(F.col("text"))).alias("categories")
    )


@query(
    "scl14_quality_score",
    f"""SELECT id, round((CASE WHEN length(title) > 20 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN length(description) > 50 THEN 0.2 ELSE 0 END)
        + (CASE WHEN len(entities) > 5 THEN 0.2 ELSE 0 END) + (CASE WHEN {any_sql('lower(source)', ('c1', 'c7'))} THEN 0.2 ELSE 0 END)
        + (CASE WHEN {AS_OF_SQL} - published_at < INTERVAL 24 HOUR THEN 0.2 ELSE 0 END), 8) AS quality FROM processed""",
    "processed",
)
def _(t: Tables):
    score = scores.quality(
        F.col("title"), F.col("description"), F.size("entities"), F.col("source"), F.col("published_at"),
        AS_OF, ("c1", "c7"),
    )
    return t.processed().select("id", r8(score).alias("quality"))


@query(
    "scl15_relevance_score",
    f"""SELECT id, round((CASE WHEN len(list_filter(entities, lambda w: length(w) % 4 IN (0, 3))) > 0 THEN 0.3 ELSE 0 END)::DOUBLE
        + (CASE WHEN len(list_filter(entities, lambda w: length(w) % 4 IN (1, 2))) > 0 THEN 0.3 ELSE 0 END)
        + (CASE WHEN list_has_any(categories, {list(RELEVANT_CATS)}) THEN 0.2 ELSE 0 END)
        + (CASE WHEN list_has_any(keywords, {list(RELEVANT_WORDS)}) THEN 0.2 ELSE 0 END), 8) AS relevance_score
      FROM processed""",
    "processed",
)
def _(t: Tables):
    e = F.col("entities")
    score = scores.relevance(
        tx.entity_texts(e, fixed.GEOGRAPHIC_LABELS), tx.entity_texts(e, fixed.POLITICAL_LABELS),
        F.col("categories"), F.col("keywords"), RELEVANT_CATS, RELEVANT_WORDS,
    )
    return t.processed().select("id", r8(score).alias("relevance_score"))


@query(
    "scl16_event_relevance",
    """SELECT id, round(((CASE WHEN title <> '' THEN 0.3 ELSE 0 END) + (CASE WHEN id % 3 <> 0 THEN 0.2 ELSE 0 END) + 0.2
        + (CASE WHEN id % 5 <> 0 THEN 0.2 ELSE 0 END) + (CASE WHEN array_to_string(keywords, ',') <> '' THEN 0.1 ELSE 0 END))::DOUBLE, 8) AS score
      FROM processed""",
    "processed",
)
def _(t: Tables):
    p = F.col("id")
    score = scores.event_relevance(
        F.col("title"), F.when(p % 3 != 0, F.col("url")), F.col("source"),
        F.when(p % 5 != 0, stamp("published_at")).otherwise(""), F.array_join("keywords", ","),
    )
    return t.processed().select("id", r8(score).alias("score"))


@query(
    "scl17_entity_candidates",
    f"""SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(trim(text), '\\s+'),
        lambda w: regexp_matches(w, '{TITLE_CASE_SQL}') AND length(w) > 2), '|') AS entities FROM documents""",
)
def _(t: Tables):
    return t.table("documents").select(
        F.col("doc_id").alias("id"), joined(tx.entity_candidates(F.col("text"))).alias("entities")
    )


@query(
    "scl18_entities_by_label",
    """SELECT id, array_to_string(list_filter(entities, lambda w: length(w) % 4 IN (0, 3)), '|') AS geographic,
        array_to_string(list_filter(entities, lambda w: length(w) % 4 IN (1, 2)), '|') AS political FROM processed""",
    "processed",
)
def _(t: Tables):
    e = F.col("entities")
    return t.processed().select(
        "id",
        joined(tx.entity_texts(e, fixed.GEOGRAPHIC_LABELS)).alias("geographic"),
        joined(tx.entity_texts(e, fixed.POLITICAL_LABELS)).alias("political"),
    )


_OPINION = ", ".join(f"('{w}', {v})" for w, v in fixed.OPINION_WORDS.items())


@query(
    "scl19_sentiment",
    f"""SELECT d.doc_id AS id, round(coalesce(avg(o.v), 0), 8) AS polarity, round(coalesce(avg(abs(o.v)), 0), 8) AS subjectivity
      FROM documents d LEFT JOIN (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS w FROM documents) t
        ON t.doc_id = d.doc_id AND t.w IN (SELECT w FROM (VALUES {_OPINION}) x(w, v))
      LEFT JOIN (SELECT w, v::DOUBLE AS v FROM (VALUES {_OPINION}) x(w, v)) o ON o.w = t.w
      GROUP BY d.doc_id""",
)
def _(t: Tables):
    return t.table("documents").select(
        F.col("doc_id").alias("id"),
        r8(tx.word_weight_mean(F.col("text"))).alias("polarity"),
        r8(tx.word_weight_share(F.col("text"))).alias("subjectivity"),
    )


@query(
    "scl20_rule_errors",
    """SELECT id, array_to_string(list_filter([
        CASE WHEN length(trim(title)) < 5 THEN 'title: must be at least 5 characters long' END,
        CASE WHEN length(trim(content)) < 10 THEN 'content: must be at least 10 characters long' END,
        CASE WHEN id % 11 = 0 THEN 'url: invalid URL' END], lambda e: e IS NOT NULL), '|') AS errors FROM article""",
    "article",
)
def _(t: Tables):
    from tidewire.operators.quality import article_errors

    odd = F.when(F.col("id") % 11 == 0, F.lit("no-scheme.example.com")).otherwise(F.col("url"))
    return t.article().withColumn("url", odd).select("id", joined(article_errors()).alias("errors"))


@query(
    "scl21_json_schema",
    """SELECT event_id, event_id % 4 = 0 AS valid, CASE WHEN event_id % 4 = 1 THEN 'name' ELSE '' END AS missing,
        CASE WHEN event_id % 4 = 2 THEN 'k' ELSE '' END AS wrong, CASE WHEN event_id % 4 = 3 THEN 'more' ELSE '' END AS extra
      FROM (SELECT event_id FROM events WHERE event_id % 4 <> 3)
      UNION ALL SELECT event_id, true, '', '', 'more' FROM events WHERE event_id % 4 = 3""",
)
def _(t: Tables):
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    text = (
        F.when(e % 4 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "name": "'), kind, F.lit('"}')))
        .when(e % 4 == 1, F.col("props"))
        .when(e % 4 == 2, F.concat(F.lit('{"k": "'), k, F.lit('", "name": "'), kind, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "name": "'), kind, F.lit('", "more": []}')))
    )
    got = t.events().select("event_id", records.schema_check(text, {"k": "number", "name": "string"}).alias("c"))
    return got.select(
        "event_id",
        F.col("c.valid").alias("valid"),
        joined("c.missing_fields").alias("missing"),
        joined("c.wrong_type_fields").alias("wrong"),
        joined("c.extra_fields").alias("extra"),
    )


_POLICY_WORDS = ("worthless", "pathetic", "confidential", "secret")


@query(
    "scl22_content_policy",
    f"""SELECT doc_id AS id, NOT {any_sql('lower(text)', _POLICY_WORDS)} AS valid,
        array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _POLICY_WORDS)}], lambda x: x IS NOT NULL), '|') AS forbidden,
        array_to_string(list_filter([CASE WHEN length(text) > 10000 THEN 'content_length' END,
          {', '.join(f"CASE WHEN regexp_matches(text, '{rx}') THEN '{n}' END" for n, rx in fixed.SENSITIVE_PATTERNS.items())}], lambda x: x IS NOT NULL), '|') AS warnings
      FROM documents""",
)
def _(t: Tables):
    got = t.table("documents").select(
        F.col("doc_id").alias("id"), records.policy(F.col("text"), _POLICY_WORDS).alias("p")
    )
    return got.select("id", "p.valid", joined("p.forbidden").alias("forbidden"), joined("p.warnings").alias("warnings"))


@query(
    "scl23_redact",
    """SELECT doc_id AS id, '[REDACTED]' AS api_key, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS body,
        '[REDACTED]' AS user_token, lang FROM documents""",
)
def _(t: Tables):
    params = F.create_map(
        F.lit("api_key"), F.col("source"), F.lit("body"), F.col("text"),
        F.lit("User_Token"), F.col("lang"), F.lit("lang"), F.col("lang"),
    )
    got = t.table("documents").select(F.col("doc_id").alias("id"), records.redact(params).alias("m"))
    return got.select(
        "id", F.col("m")["api_key"].alias("api_key"), F.col("m")["body"].alias("body"),
        F.col("m")["User_Token"].alias("user_token"), F.col("m")["lang"].alias("lang"),
    )


@query(
    "scl24_log_fingerprint",
    f"""SELECT pos, sha256(agent || ':run:{{"k":"' || {PROP_K} || '","run":"' || run_id || '"}}:{{"status":"' || status || '"}}') AS fingerprint FROM agent_log""",
    "agent_log",
)
def _(t: Tables):
    params = F.create_map(
        F.lit("run"), F.col("run_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")
    )
    result = F.create_map(F.lit("status"), F.col("status"))
    return t.agent_log().select(
        "pos", records.log_fingerprint(F.col("agent"), F.col("action"), params, result).alias("fingerprint")
    )


@query("scl25_cache_key", "SELECT id, md5(title || ':' || language || ':model') AS cache_key FROM article", "article")
def _(t: Tables):
    return t.article().select(
        "id", records.cache_key(F.col("title"), F.col("language"), F.lit("model")).alias("cache_key")
    )


_DOMS = ("Geopolitical", "Economic / Trade / Sanctions", "Technological Competition")


@query(
    "scl26_parse_domains",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Geopolitical' WHEN 'view' THEN 'Economic / Trade / Sanctions|Technological Competition'
        WHEN 'error' THEN 'Uncategorized' WHEN 'signup' THEN 'Cultural / Identity Clashes' ELSE '' END AS domains,
        CASE event_type WHEN 'view' THEN 0.7 WHEN 'purchase' THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM events""",
)
def _(t: Tables):
    k = F.col("event_type")
    reply = (
        F.when(k == "click", " geopolitical, nonsense ").when(k == "view", "Trade , technological competition,")
        .when(k == "error", "Geopolitical, UNCATEGORIZED").when(k == "signup", "identity clashes").otherwise("other things")
    )
    got = t.events().select("event_id", tx.parse_domains(reply).alias("d"))
    return got.select("event_id", joined("d").alias("domains"), tx.domain_confidence(F.col("d")).alias("confidence"))


@query(
    "scl27_translation_acceptable",
    """SELECT id, length(description) / greatest(length(content), 1)::DOUBLE > 0.1 AND trim(description) <> '' AS ok FROM article""",
    "article",
)
def _(t: Tables):
    return t.article().select("id", tx.translation_acceptable(F.col("content"), F.col("description")).alias("ok"))


_LANG_COUNTS = ", ".join(
    f"len(list_filter(tok, lambda w: w IN ({', '.join(repr(x) for x in ws)}))) AS n_{lang}"
    for lang, ws in fixed.FUNCTION_WORDS.items()
)


@query(
    "scl28_guess_language",
    f"""SELECT id, CASE WHEN greatest(n_en, n_fr, n_de, n_es) = 0 THEN 'unknown' WHEN n_en >= greatest(n_fr, n_de, n_es) THEN 'en'
        WHEN n_fr >= greatest(n_de, n_es) THEN 'fr' WHEN n_de >= n_es THEN 'de' ELSE 'es' END AS language FROM (
      SELECT id, {_LANG_COUNTS} FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '{tx.WORD}') AS tok FROM documents))""",
)
def _(t: Tables):
    return t.table("documents").select(F.col("doc_id").alias("id"), tx.guess_language(F.col("text")).alias("language"))


@query("scl29_run_id")
def _(t: Tables):
    """A fresh id every run, so only its shape can be checked."""
    return t.agent_log().groupBy("run_id").count().select("run_id", records.run_id(AS_OF).alias("workflow_id"))


@query(
    "scl30_domain_words",
    """SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(replace(replace(source || '/' || country || ' x-y', '/', ' '), '-', ' ')), ' +'), lambda w: w <> ''))), '|') AS words
      FROM article""",
    "article",
)
def _(t: Tables):
    names = F.array(F.concat("source", F.lit("/"), "country"), F.lit("x-y"))
    return t.article().select("id", joined(F.array_sort(tx.domain_words(names))).alias("words"))


@query(
    "scl31_chunk_number",
    """SELECT event_id, client, (row_number() OVER (PARTITION BY client, d ORDER BY ts, event_id) - 1) // 5 AS chunk FROM (
        SELECT event_id, user_id AS client, ts, CAST(ts AS DATE) AS d FROM events)""",
)
def _(t: Tables):
    from tidewire.operators.scans import chunk_number

    rows = t.request_log().withColumn("day", F.to_date("ts"))
    return chunk_number(rows, ["client", "day"], 5, "ts", "pos").select(
        F.col("pos").alias("event_id"), "client", "chunk"
    )


@query(
    "scl32_feed_country_fallback",
    """SELECT id, CASE WHEN language = 'en' THEN 'gb' WHEN language = 'fr' THEN 'fr' WHEN id % 2 = 0 THEN country ELSE 'US' END AS country
      FROM article""",
    "article",
)
def _(t: Tables):
    known = F.create_map(F.lit("gb"), F.array(F.lit("en")), F.lit("fr"), F.array(F.lit("fr")))
    ents = F.when(F.col("id") % 2 == 0, F.array("country")).otherwise(F.array().cast("array<string>"))
    return t.article().select("id", urls.feed_country_fallback(F.col("language"), known, ents).alias("country"))


@query(
    "set03_intersection_ratio",
    """SELECT a.id, round(len(list_intersect(a.keywords, b.keywords)) / greatest(len(b.keywords), 1)::DOUBLE, 8) AS ratio
      FROM processed a JOIN processed b ON b.id = a.id + 1""",
    "processed",
)
def _(t: Tables):
    a = t.processed().select("id", F.col("keywords").alias("k1"))
    b = t.processed().select((F.col("id") - 1).alias("id"), F.col("keywords").alias("k2"))
    ratio = F.size(F.array_intersect("k1", "k2")) / F.greatest(F.size("k2"), F.lit(1))
    return a.join(b, "id").select("id", r8(ratio).alias("ratio"))


@query(
    "set04_distinct_in_order",
    f"""SELECT id, array_to_string(list_filter(tok, lambda w, i: list_position(tok, w) = i), '|') AS words FROM (
      SELECT id, {tokens_sql('lower(title)')} AS tok FROM article)""",
    "article",
)
def _(t: Tables):
    tok = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != "")
    return t.article().select("id", joined(F.array_distinct(tok)).alias("words"))


@query(
    "set05_map_merge",
    """SELECT id, source AS a, country AS b, language AS c, title || '|' || source AS joined FROM article""",
    "article",
)
def _(t: Tables):
    left = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("old"))
    right = F.create_map(F.lit("b"), F.col("country"), F.lit("c"), F.col("language"))
    got = t.article().select(
        "id", records.merge_maps(left, right).alias("m"),
        joined(F.concat(F.array("title"), F.array("source"))).alias("joined"),
    )
    return got.select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"), "joined")
