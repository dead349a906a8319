"""Topics, countries, risks, statistics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewire import fixed
from tidewire.catalog.base import (
    AS_OF, AS_OF_SQL, CONFLICT, STAMP, THEMES, URGENT, Tables, any_sql, joined, query, r8, stamp,
)
from tidewire.catalog.joins import PRICED_SQL
from tidewire.functions import text as tx
from tidewire.functions.records import json_list
from tidewire.operators import dedup, limits, quality, resolve, risk, stats, trends

KW = "array_to_string(keywords, ' ')"

TOPICS_SQL = """kw AS (SELECT unnest(keywords) AS topic FROM processed),
  topics AS (SELECT topic, count(*) AS n FROM kw GROUP BY 1 ORDER BY n DESC, topic LIMIT {k}),
  period AS (SELECT * FROM processed WHERE published_at BETWEEN TIMESTAMP '2024-01-31' - INTERVAL {d} DAY AND TIMESTAMP '2024-01-31'),
  rows_ AS (SELECT t.topic, p.* FROM topics t JOIN period p ON contains(array_to_string(p.keywords, ' '), t.topic))"""


@query(
    "ag01_top_topics",
    "SELECT topic, count(*) AS n FROM (SELECT unnest(keywords) AS topic FROM processed) GROUP BY 1 ORDER BY n DESC, topic LIMIT 20",
    "processed",
)
def _(t: Tables):
    return trends.topics(t.processed())


_TREND_COLS = ["topic", "article_count", "volume_trend", "sentiment_trend", "confidence"]


def _trend_sql(k: int, d: int, having: str) -> str:
    return f"""WITH {TOPICS_SQL.format(k=k, d=d)}
      SELECT topic, count(*) AS article_count, round(count(*) / (SELECT count(DISTINCT CAST(published_at AS DATE)) FROM period)::DOUBLE, 8) AS volume_trend,
        round(coalesce(avg(sentiment), 0), 8) AS sentiment_trend, least(count(*) / 10.0, 1.0)::DOUBLE AS confidence
      FROM rows_ GROUP BY topic HAVING count(*) >= 3 {having}"""


def _rounded(df):
    return df.withColumns({"volume_trend": r8("volume_trend"), "sentiment_trend": r8("sentiment_trend")}).select(*_TREND_COLS)


@query("ag02_topic_trends", _trend_sql(15, 9, "AND least(count(*) / 10.0, 1.0) > 0.5"), "processed")
def _(t: Tables):
    return _rounded(trends.topic_trends(t.processed(), AS_OF, 9))


@query("ag02_topic_trends_pipeline", _trend_sql(10, 9, ""), "processed")
def _(t: Tables):
    return _rounded(trends.topic_trends(t.processed(), AS_OF, 9, max_topics=10, min_confidence=None))


@query(
    "ag03_related_topics",
    f"""WITH {TOPICS_SQL.format(k=15, d=9)}
      SELECT topic, related, n FROM (SELECT topic, related, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, related) AS r
        FROM (SELECT topic, unnest(keywords) AS related FROM rows_) GROUP BY 1, 2) WHERE r <= 5 AND related <> topic""",
    "processed",
)
def _(t: Tables):
    return trends.related_topics(trends.topic_articles(t.processed(), AS_OF, 9)).select("topic", "related", "n")


@query(
    "ag04_key_entities",
    f"""WITH {TOPICS_SQL.format(k=15, d=9)}
      SELECT topic, entity, n FROM (SELECT topic, entity, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, entity) AS r
        FROM (SELECT topic, unnest(entities) AS entity FROM rows_) GROUP BY 1, 2) WHERE r <= 5""",
    "processed",
)
def _(t: Tables):
    return trends.key_entities(trends.topic_articles(t.processed(), AS_OF, 9)).select("topic", "entity", "n")


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


RISK_SQL = (
    f"least(1.0, 0.4 * {share('sentiment < -0.2')} + 0.3 * {share('relevance > 0.8')} + 0.3 * {share(any_sql(KW, CONFLICT))})"
)


@query(
    "ag05_geo_patterns",
    f"""WITH k AS (SELECT country, keyword, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, keyword) AS r
        FROM (SELECT country, unnest(keywords) AS keyword FROM processed) GROUP BY 1, 2),
      top AS (SELECT country, string_agg(keyword, '|' ORDER BY r) AS key_topics FROM k WHERE r <= 5 GROUP BY 1),
      h AS (SELECT country, avg(sentiment) FILTER (r <= n // 2) AS early, avg(sentiment) FILTER (r > n // 2) AS late FROM (
          SELECT country, sentiment, row_number() OVER (PARTITION BY country ORDER BY published_at, pos) AS r, count(*) OVER (PARTITION BY country) AS n FROM processed) GROUP BY 1)
      SELECT p.country, count(*) AS article_count, round(coalesce(avg(sentiment), 0), 8) AS avg_sentiment, round({RISK_SQL}, 8) AS risk_score, any_value(key_topics) AS key_topics,
        any_value(CASE WHEN late - early > 0.1 THEN 'increasing' WHEN early - late > 0.1 THEN 'decreasing' ELSE 'stable' END) AS trend_direction
      FROM processed p JOIN top USING (country) JOIN h USING (country) GROUP BY p.country HAVING count(*) >= 3""",
    "processed",
)
def _(t: Tables):
    got = trends.country_patterns(t.processed(), conflict_words=CONFLICT)
    return got.withColumns(
        {"avg_sentiment": r8("avg_sentiment"), "risk_score": r8("risk_score"), "key_topics": joined("key_topics")}
    )


@query(
    "ag06_country_risk",
    f"""SELECT country, count(*) AS article_count, round(coalesce(avg(sentiment), 0), 8) AS avg_sentiment, round({RISK_SQL}, 8) AS risk_score
      FROM processed GROUP BY 1 HAVING count(*) >= 3""",
    "processed",
)
def _(t: Tables):
    got = trends.country_risk(t.processed(), conflict_words=CONFLICT)
    return got.withColumns({"avg_sentiment": r8("avg_sentiment"), "risk_score": r8("risk_score")})


_CORR = """SELECT count(*) AS sample_size, corr(sentiment, relevance) AS a, corr(sentiment, quality) AS b, corr(relevance, quality) AS c,
    corr(len(entities), relevance) AS d, corr(len(keywords), relevance) AS e FROM processed WHERE sentiment IS NOT NULL AND relevance > 0"""


@query(
    "ag07_correlations",
    f"""WITH x AS ({_CORR}) SELECT 'sentiment' AS variable1, 'relevance' AS variable2, round(a, 8) AS coefficient, sample_size FROM x
      UNION ALL SELECT 'sentiment', 'quality', round(b, 8), sample_size FROM x UNION ALL SELECT 'relevance', 'quality', round(c, 8), sample_size FROM x
      UNION ALL SELECT 'entity_count', 'relevance', round(d, 8), sample_size FROM x UNION ALL SELECT 'keyword_count', 'relevance', round(e, 8), sample_size FROM x""",
    "processed",
)
def _(t: Tables):
    return trends.correlations(t.processed()).withColumn("coefficient", r8("coefficient"))


@query("ag07_correlation_significance")
def _(t: Tables):
    """p-values need the incomplete beta function, which SQL lacks; tested against known values."""
    return trends.with_significance(trends.correlations(t.processed()))


def _risk(df):
    return df.select(
        "risk_type", "risk_level", r8("confidence").alias("confidence"), "impact_score",
        joined("factors").alias("factors"), joined("recommendations").alias("recommendations"),
    )


def _advice(kind: str) -> str:
    return "|".join(risk.ADVICE[kind])


@query(
    "ag08_sentiment_risk",
    f"""SELECT 'sentiment_risk' AS risk_type, CASE WHEN r > 0.5 THEN 'high' ELSE 'medium' END AS risk_level, round(r, 8) AS confidence, 0.7::DOUBLE AS impact_score,
        'High negative sentiment ratio: ' || printf('%.2f', r) AS factors, '{_advice("sentiment_risk")}' AS recommendations
      FROM (SELECT {share('sentiment < -0.3')} AS r FROM processed) WHERE r > 0.3""",
    "processed",
)
def _(t: Tables):
    return _risk(risk.sentiment_risk(t.processed()))


@query(
    "ag09_geographic_risk",
    f"""SELECT 'geographic_risk' AS risk_type, CASE WHEN s > 0.8 THEN 'high' ELSE 'medium' END AS risk_level, round(s, 8) AS confidence, 0.8::DOUBLE AS impact_score,
        'High risk in ' || country || ': ' || printf('%.2f', s) AS factors, 'Focus monitoring on ' || country || '|Analyze regional implications|Coordinate with regional experts' AS recommendations
      FROM (SELECT country, {RISK_SQL} AS s FROM processed GROUP BY 1 HAVING count(*) >= 3) WHERE s > 0.3 ORDER BY s DESC, country LIMIT 1""",
    "processed",
)
def _(t: Tables):
    return _risk(risk.geographic_risk(t.processed(), threshold=0.3, conflict_words=CONFLICT))


@query(
    "ag10_temporal_risk",
    f"""SELECT 'temporal_risk' AS risk_type, 'medium' AS risk_level, 0.6::DOUBLE AS confidence, 0.6::DOUBLE AS impact_score,
        'High recent activity with negative sentiment' AS factors, '{_advice("temporal_risk")}' AS recommendations
      FROM (SELECT count(*) AS n, count_if(published_at >= {AS_OF_SQL} - INTERVAL 480 HOUR) AS f, avg(sentiment) FILTER (published_at >= {AS_OF_SQL} - INTERVAL 480 HOUR) AS m
        FROM processed WHERE sentiment < 0.3) WHERE n >= 5 AND f > n * 0.4 AND m < -0.2""",
    "processed",
)
def _(t: Tables):
    return _risk(risk.temporal_risk(t.processed().where("sentiment < 0.3"), AS_OF, hours=480, share=0.4))


@query(
    "ag11_content_risk",
    f"""SELECT 'content_risk' AS risk_type, CASE WHEN r > 0.1 THEN 'high' ELSE 'medium' END AS risk_level, round(r, 8) AS confidence, 0.8::DOUBLE AS impact_score,
        'High-risk content detected: ' || n || ' articles' AS factors, '{_advice("content_risk")}' AS recommendations
      FROM (SELECT {share(f"relevance > 0.8 AND {any_sql(KW, URGENT)}")} AS r, count_if(relevance > 0.8 AND {any_sql(KW, URGENT)}) AS n FROM processed) WHERE n > 0""",
    "processed",
)
def _(t: Tables):
    return _risk(risk.content_risk(t.processed(), URGENT))


@query(
    "ag12_summary",
    f"""WITH c AS (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM processed) GROUP BY 1 ORDER BY n DESC, category LIMIT 5),
      g AS (SELECT country FROM processed GROUP BY 1 HAVING count(*) >= 3)
      SELECT count(*) AS total_articles, round(avg(sentiment), 8) AS avg_sentiment, round(avg(relevance), 8) AS avg_relevance, round(avg(quality), 8) AS avg_quality,
        (SELECT string_agg(category, '|' ORDER BY n DESC, category) FROM c) AS top_categories, (SELECT count(*) FROM g) AS countries_analyzed FROM processed""",
    "processed",
)
def _(t: Tables):
    p = t.processed()
    got = risk.summary(
        p, trends.topic_trends(p, AS_OF, 9), trends.country_risk(p), risk.all_risks(p, AS_OF, CONFLICT, URGENT)
    )
    return got.select(
        "total_articles", *[r8(c).alias(c) for c in ("avg_sentiment", "avg_relevance", "avg_quality")],
        joined("top_categories").alias("top_categories"), "countries_analyzed",
    )


@query(
    "ag13_sentiment_histogram",
    """WITH b AS (SELECT min(sentiment) AS lo, (max(sentiment) - min(sentiment)) / 20 AS st FROM processed)
      SELECT CAST(least(floor((sentiment - lo) / st), 19) AS BIGINT) AS bin, count(*) AS n, round(any_value(lo) + CAST(least(floor((sentiment - lo) / st), 19) AS BIGINT) * any_value(st), 6) AS bin_start
      FROM processed, b WHERE sentiment IS NOT NULL GROUP BY 1""",
    "processed",
)
def _(t: Tables):
    return trends.histogram(t.processed(), "sentiment").withColumn("bin_start", F.round("bin_start", 6))


@query(
    "ag14_report_sizes",
    f"""WITH {TOPICS_SQL.format(k=15, d=9)}, tr AS (SELECT topic FROM rows_ GROUP BY 1 HAVING count(*) >= 3 AND least(count(*) / 10.0, 1.0) > 0.5),
      g AS (SELECT country, {RISK_SQL} AS s FROM processed GROUP BY 1 HAVING count(*) >= 3)
      SELECT 'trends' AS part, (SELECT count(*) FROM tr) AS n UNION ALL SELECT 'countries', (SELECT count(*) FROM g) UNION ALL SELECT 'country_map', (SELECT count(*) FROM g)
      UNION ALL SELECT 'correlations', 5 UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'top_trends', (SELECT least(count(*), 10) FROM tr)""",
    "processed",
)
def _(t: Tables):
    from tidewire.plans.report import report

    parts = report(t.processed(), AS_OF, 9, CONFLICT, URGENT)
    out = None
    for name in ("trends", "countries", "country_map", "correlations", "summary", "top_trends"):
        row = parts[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_REPORT = f"""{TOPICS_SQL.format(k=15, d=9)},
  tr AS (SELECT topic, least(count(*) / 10.0, 1.0)::DOUBLE AS confidence FROM rows_ GROUP BY 1 HAVING count(*) >= 3 AND least(count(*) / 10.0, 1.0) > 0.5),
  g AS (SELECT country, {RISK_SQL}::DOUBLE AS s FROM processed GROUP BY 1 HAVING count(*) >= 3),
  x AS ({_CORR}),
  m AS (SELECT count(*) AS n, {share('sentiment < -0.3')} AS neg, {share(f"relevance > 0.8 AND {any_sql(KW, URGENT)}")} AS urg,
      count_if(published_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS f, avg(sentiment) FILTER (published_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS mood,
      avg(sentiment) AS s, avg(relevance) AS r, avg(quality) AS q, min(sentiment) AS lo, (max(sentiment) - min(sentiment)) / 20 AS st FROM processed),
  risks AS (SELECT 'sentiment_risk' AS name, neg AS value, CASE WHEN neg > 0.5 THEN 'high' ELSE 'medium' END AS note FROM m WHERE neg > 0.3
    UNION ALL SELECT 'content_risk', urg, CASE WHEN urg > 0.1 THEN 'high' ELSE 'medium' END FROM m WHERE urg > 0
    UNION ALL SELECT 'temporal_risk', 0.6, 'medium' FROM m WHERE n >= 5 AND f > n * 0.5 AND mood < -0.2
    UNION ALL (SELECT 'geographic_risk', s, CASE WHEN s > 0.8 THEN 'high' ELSE 'medium' END FROM g WHERE s > 0.6 ORDER BY s DESC, country LIMIT 1))"""


@query(
    "ag14_report_values",
    f"""WITH {_REPORT}
      SELECT part, name, round(value::DOUBLE, 8) AS value, note FROM (
        SELECT 'risks' AS part, name, value, note FROM risks
        UNION ALL SELECT 'trends', topic, confidence, NULL FROM tr
        UNION ALL SELECT 'countries', country, s, NULL FROM g
        UNION ALL SELECT 'correlations', 'sentiment/relevance', a, NULL FROM x UNION ALL SELECT 'correlations', 'sentiment/quality', b, NULL FROM x
        UNION ALL SELECT 'correlations', 'relevance/quality', c, NULL FROM x UNION ALL SELECT 'correlations', 'entity_count/relevance', d, NULL FROM x
        UNION ALL SELECT 'correlations', 'keyword_count/relevance', e, NULL FROM x
        UNION ALL SELECT 'histogram', CAST(CAST(least(floor((sentiment - lo) / st), 19) AS BIGINT) AS VARCHAR), count(*), NULL FROM processed, m WHERE sentiment IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'summary', 'total_articles', n, NULL FROM m UNION ALL SELECT 'summary', 'avg_sentiment', s, NULL FROM m
        UNION ALL SELECT 'summary', 'avg_relevance', r, NULL FROM m UNION ALL SELECT 'summary', 'avg_quality', q, NULL FROM m
        UNION ALL SELECT 'summary', 'trends_count', (SELECT count(*) FROM tr), NULL UNION ALL SELECT 'summary', 'countries_analyzed', (SELECT count(*) FROM g), NULL
        UNION ALL SELECT 'summary', 'high_risks', (SELECT count(*) FROM risks WHERE note = 'high'), NULL
        UNION ALL SELECT 'summary', 'medium_risks', (SELECT count(*) FROM risks WHERE note = 'medium'), NULL)""",
    "processed",
)
def _(t: Tables):
    from tidewire.plans.report import report

    parts = report(t.processed(), AS_OF, 9, CONFLICT, URGENT)
    none = F.lit(None).cast("string")

    def rows(part: str, name, value, frame: str | None = None, note=none):
        named = [F.lit(part).alias("part"), name.alias("name"), F.round(value.cast("double"), 8).alias("value"), note.alias("note")]
        return parts[frame or part].select(*named)

    counts = ("total_articles", "avg_sentiment", "avg_relevance", "avg_quality", "trends_count", "countries_analyzed", "high_risks", "medium_risks")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in counts])).alias("s")
    parts["each"] = parts["summary"].select(each).select("s.*")
    out = [
        rows("risks", F.col("risk_type"), F.col("confidence"), note=F.col("risk_level")),
        rows("trends", F.col("topic"), F.col("confidence")),
        rows("countries", F.col("country"), F.col("risk_score")),
        rows("correlations", F.concat_ws("/", "variable1", "variable2"), F.col("coefficient")),
        rows("histogram", F.col("bin").cast("string"), F.col("n"), "sentiment_histogram"),
        rows("summary", F.col("name"), F.col("value"), "each"),
    ]
    return reduce(DataFrame.unionByName, out)


@query(
    "ag15_themes",
    "SELECT theme, count(*) AS n FROM hotspot JOIN (VALUES "
    + ", ".join(f"('{w}')" for w in THEMES)
    + ") x(theme) ON contains(lower(title), theme) OR contains(lower(summary), theme) GROUP BY 1 ORDER BY n DESC, theme LIMIT 10",
    "hotspot",
)
def _(t: Tables):
    return stats.themes(t.hotspot(), THEMES)


@query(
    "ag16_entity_counts",
    """SELECT entity, count(*) AS n FROM (SELECT unnest(kw[1:3]) || ' (word)' AS entity FROM (SELECT pos // 10 AS id, arg_min(keywords, pos) AS kw FROM processed GROUP BY 1) WHERE id % 7 <> 0)
      GROUP BY 1 ORDER BY n DESC, entity LIMIT 20""",
    "processed",
)
def _(t: Tables):
    return stats.entity_counts(t.hotspot())


@query(
    "ag17_geo_distribution",
    """SELECT lower(e) AS entity, count(*) AS n FROM (SELECT unnest(entities) AS e FROM flashpoint) WHERE lower(trim(e)) IN (SELECT alias FROM alias) GROUP BY 1""",
    "flashpoint alias",
)
def _(t: Tables):
    fp = t.flashpoint()
    known = resolve.resolve_countries(
        fp.select(F.explode("entities").alias("entity")), t.aliases(), fuzzy_cutoff=None
    )
    return stats.country_distribution(fp, known)


@query(
    "ag18_store_stats",
    f"""SELECT 'flashpoint' AS table_name, count(*) AS total, count_if(created_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS last_24h FROM flashpoint
      UNION ALL SELECT 'feed', count(*), count_if(created_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) FROM feed
      UNION ALL SELECT 'agent_log', count(*), NULL FROM agent_log""",
    "flashpoint feed agent_log",
)
def _(t: Tables):
    logs = t.agent_log().withColumnRenamed("ts", "created_at")
    return stats.store_stats(
        {"flashpoint": t.flashpoint(), "feed": t.feed(), "agent_log": logs}, AS_OF, ("flashpoint", "feed")
    )


@query(
    "ag19_day_stats",
    """SELECT 'total' AS kind, 'flashpoints' AS key, count(*) AS n FROM flashpoint UNION ALL SELECT 'total', 'feeds', count(*) FROM feed
      UNION ALL SELECT 'domain', domain, count(*) FROM feed GROUP BY domain UNION ALL SELECT 'language', language, count(*) FROM feed GROUP BY language""",
    "flashpoint feed",
)
def _(t: Tables):
    return stats.day_stats(t.flashpoint(), t.feed())


_LOG = """count(*) AS executions, count_if(status = 'success') AS successful, count_if(status <> 'success') AS failed,
    round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 8) AS success_rate, round(sum(execution_time), 6) AS total_time,
    round(avg(execution_time), 8) AS avg_time, max(execution_time) AS max_time"""


def _log_rounded(df):
    return df.withColumns(
        {"success_rate": r8("success_rate"), "total_time": F.round("total_time", 6), "avg_time": r8("avg_time")}
    )


@query("ag20_audit_by_agent", f"SELECT run_id, agent, {_LOG} FROM agent_log GROUP BY 1, 2", "agent_log")
def _(t: Tables):
    return _log_rounded(stats.audit_by_agent(t.agent_log(), "run_id"))


@query("ag20_audit_by_run", f"SELECT run_id, {_LOG} FROM agent_log GROUP BY 1", "agent_log")
def _(t: Tables):
    return _log_rounded(stats.audit_by_run(t.agent_log()))


@query(
    "ag21_session_costs",
    f"""SELECT session, count(*) AS total_calls, sum(input_tokens) AS total_input_tokens, sum(output_tokens) AS total_output_tokens, round(sum(cost), 8) AS total_cost,
        round(sum(cost) / count(*), 12) AS avg_cost_per_call, round((sum(input_tokens) + sum(output_tokens)) / count(*)::DOUBLE, 8) AS avg_tokens_per_call,
        count_if(cost > 0.10) AS high_cost_calls, sum(cost) / count(*) > 0.05 AS advise_batching, sum(input_tokens) > sum(output_tokens) * 10 AS advise_shorter_prompts, sum(cost) > 1.0 AS advise_cheaper_model
      FROM ({PRICED_SQL}) GROUP BY session""",
    "usage",
)
def _(t: Tables):
    from tidewire.sources import dims

    priced = resolve.price_calls(t.usage(), dims.prices(t.spark), fixed.DEFAULT_PRICE)
    got = stats.session_costs(priced)
    return got.withColumns(
        {
            "total_cost": r8("total_cost"),
            "avg_cost_per_call": F.round("avg_cost_per_call", 12),
            "avg_tokens_per_call": r8("avg_tokens_per_call"),
        }
    )


@query(
    "ag22_event_confidence",
    "SELECT event_id, count(*) AS claims, round(0.8 * avg(CASE WHEN verdict = 'true' THEN 1.0 ELSE 0 END) + 0.4 * avg(CASE WHEN verdict = 'uncertain' THEN 1.0 ELSE 0 END), 2) AS confidence FROM claim GROUP BY 1",
    "claim",
)
def _(t: Tables):
    return stats.event_confidence(t.claim())


def _items(t: Tables):
    p = F.col("pos")
    url = F.when(p % 6 == 0, "").otherwise(F.col("url"))
    kind = F.when(p % 4 == 0, "event").otherwise("article")
    return t.article().select("pos", kind.alias("type"), "title", url.alias("url"), "source")


_ITEMS = "(SELECT pos, CASE WHEN pos % 4 = 0 THEN 'event' ELSE 'article' END AS type, title, CASE WHEN pos % 6 = 0 THEN '' ELSE url END AS url, source FROM article)"


@query(
    "ag23_merge_quality",
    f"""SELECT type, count(*) AS total, count_if(title <> '' AND url <> '') AS valid, count_if(NOT (title <> '' AND url <> '')) AS invalid,
        round((SELECT avg(CASE WHEN title <> '' AND url <> '' THEN 1.0 ELSE 0 END) FROM {_ITEMS}), 8) AS overall_quality FROM {_ITEMS} GROUP BY 1""",
    "article",
)
def _(t: Tables):
    return stats.merge_quality(_items(t)).withColumn("overall_quality", r8("overall_quality"))


@query(
    "ag23_merge_issues",
    f"SELECT type, pos, 'Invalid ' || type || ': ' || title AS issue FROM {_ITEMS} WHERE NOT (title <> '' AND url <> '')",
    "article",
)
def _(t: Tables):
    return stats.merge_issues(_items(t))


@query(
    "ag24_stage_metrics",
    """SELECT stage, sum(i) AS total_processed, sum(o) AS total_output, sum(e) AS total_errors, round(avg(value), 8) AS average_time FROM (
        SELECT event_type AS stage, user_id AS i, user_id - user_id % 3 AS o, user_id % 2 AS e, value FROM events) GROUP BY 1""",
)
def _(t: Tables):
    u = F.col("user_id")
    m = t.events().select(
        F.col("event_type").alias("stage"), u.alias("input_count"), (u - u % 3).alias("output_count"),
        (u % 2).alias("error_count"), F.col("value").alias("processing_time"),
    )
    return stats.stage_metrics(m).withColumn("average_time", r8("average_time"))


@query(
    "ag25_language_stats",
    "SELECT count(*) AS total, (SELECT string_agg(language, '|' ORDER BY language) FROM (SELECT DISTINCT language FROM article)) AS languages, count_if(language <> 'en') AS needs_translation FROM article",
    "article",
)
def _(t: Tables):
    return stats.language_stats(t.article()).withColumn("languages", joined("languages"))


@query(
    "ag26_cluster_digest",
    """SELECT source AS cluster, count(*) AS size, (SELECT string_agg(title, '; ' ORDER BY pos) FROM (SELECT title, pos FROM article b WHERE b.source = a.source AND title <> '' ORDER BY pos LIMIT 3)) AS summary
      FROM article a GROUP BY source""",
    "article",
)
def _(t: Tables):
    return stats.cluster_digest(t.article().select(F.col("source").alias("cluster"), "pos", "title"))


@query(
    "ag27_task_stats",
    """SELECT count(*) AS total_tasks, round(sum(execution_time), 6) AS total_time, round(avg(execution_time), 8) AS average_time, count_if(status = 'failed') AS failed_tasks,
        round(avg(CASE WHEN status <> 'failed' THEN 1.0 ELSE 0 END), 8) AS success_rate, CAST(sum(retries) AS BIGINT) AS retry_count FROM agent_log""",
    "agent_log",
)
def _(t: Tables):
    got = stats.task_stats(t.agent_log())
    return got.withColumns(
        {"total_time": F.round("total_time", 6), "average_time": r8("average_time"), "success_rate": r8("success_rate")}
    )


_HIT = "list_contains(keywords, 'that') OR list_contains(keywords, 'nicht')"


def _hit():
    return F.array_contains("keywords", F.lit("that")) | F.array_contains("keywords", F.lit("nicht"))


def _timeline(t: Tables, mode: str):
    got = trends.timeline(t.processed(), mode, _hit())
    return got.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "series", r8("value").alias("value"), "norm")


for _mode, _sql in {
    "timelinevol": f"SELECT strftime(published_at, '%Y-%m-%d') AS day, 'Volume Intensity' AS series, round(count_if({_HIT}) * 100.0 / count(*), 8) AS value, count(*) AS norm FROM processed GROUP BY 1",
    "timelinevolraw": f"SELECT strftime(published_at, '%Y-%m-%d') AS day, 'Article Count' AS series, CAST(count_if({_HIT}) AS DOUBLE) AS value, count(*) AS norm FROM processed GROUP BY 1",
    "timelinetone": f"SELECT strftime(published_at, '%Y-%m-%d') AS day, 'Average Tone' AS series, round(avg(sentiment), 8) AS value, count(*) AS norm FROM processed WHERE {_HIT} GROUP BY 1",
    "timelinelang": f"SELECT strftime(published_at, '%Y-%m-%d') AS day, language AS series, round(count(*) * 100.0 / any_value(norm), 8) AS value, any_value(norm) AS norm FROM (SELECT *, count(*) OVER (PARTITION BY CAST(published_at AS DATE)) AS norm FROM processed) WHERE {_HIT} GROUP BY 1, 2",
    "timelinesourcecountry": f"SELECT strftime(published_at, '%Y-%m-%d') AS day, country AS series, round(count(*) * 100.0 / any_value(norm), 8) AS value, any_value(norm) AS norm FROM (SELECT *, count(*) OVER (PARTITION BY CAST(published_at AS DATE)) AS norm FROM processed) WHERE {_HIT} GROUP BY 1, 2",
}.items():
    query(f"ag28_{_mode}", _sql, "processed")(lambda t, m=_mode: _timeline(t, m))


@query(
    "ag28_wide_timeline",
    """SELECT day, round(max(v) FILTER (language = 'en'), 8) AS en, round(max(v) FILTER (language = 'fr'), 8) AS fr, round(max(v) FILTER (language = 'de'), 8) AS de, round(max(v) FILTER (language = 'es'), 8) AS es FROM (
        SELECT strftime(published_at, '%Y-%m-%d') AS day, language, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY strftime(published_at, '%Y-%m-%d')) AS v FROM article GROUP BY 1, 2) GROUP BY 1""",
    "article",
)
def _(t: Tables):
    langs = ["en", "fr", "de", "es"]
    series = trends.timeline(t.processed(), "timelinelang", F.lit(True))
    wide = trends.wide_timeline(series, langs)
    return wide.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[r8(c).alias(c) for c in langs])


@query(
    "ag29_validation_report",
    "SELECT length(trim(title)) >= 5 AND length(trim(content)) >= 10 AS valid, count(*) AS n FROM article GROUP BY 1",
    "article",
)
def _(t: Tables):
    return quality.validation_report(t.article(), quality.article_errors())


@query(
    "ag29_invalid_hotspots",
    """SELECT id, array_to_string(list_filter([CASE WHEN confidence_score > 0.9 THEN NULL END, CASE WHEN len(article_urls) < 1 THEN 'article_urls: at least one article URL is required' END], lambda e: e IS NOT NULL), '|') AS errors
      FROM hotspot WHERE len(article_urls) < 1""",
    "hotspot",
)
def _(t: Tables):
    got = quality.invalid_rows(t.hotspot(), quality.hotspot_errors())
    return got.withColumn("errors", joined("errors"))


@query(
    "ag29_invalid_flashpoints",
    """SELECT id, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'title: cannot be empty' END, CASE WHEN trim(description) = '' THEN 'description: cannot be empty' END,
        CASE WHEN len(entities) < 1 THEN 'entities: cannot be empty' END], lambda e: e IS NOT NULL), '|') AS errors FROM flashpoint WHERE trim(title) = '' OR trim(description) = '' OR len(entities) < 1""",
    "flashpoint",
)
def _(t: Tables):
    return quality.invalid_rows(t.flashpoint(), quality.flashpoint_errors()).withColumn("errors", joined("errors"))


@query(
    "ag30_business_rules",
    """SELECT 'no_empty_hotspots' AS rule, CAST(id AS VARCHAR) AS id, 'Hotspot has no associated articles' AS message FROM hotspot WHERE len(article_urls) = 0
      UNION ALL SELECT 'no_duplicate_urls', url, 'URL occurs more than once' FROM (SELECT unnest(article_urls) AS url FROM hotspot) GROUP BY url HAVING count(*) > 1
      UNION ALL SELECT 'minimum_confidence_threshold', CAST(id AS VARCHAR), 'Confidence below threshold' FROM hotspot WHERE confidence_score < 0.4
      UNION ALL SELECT 'valid_date_format', CAST(id AS VARCHAR), 'Invalid date format: ' || 'day ' || id FROM hotspot WHERE id % 8 = 3""",
    "hotspot",
)
def _(t: Tables):
    text = F.when(F.col("id") % 8 == 3, F.concat(F.lit("day "), F.col("id").cast("string"))).otherwise(
        stamp("created_at")
    )
    return quality.business_rules(t.hotspot().withColumn("created_at", text), 0.4)


@query(
    "ag31_consistency",
    """SELECT 'missing_article_urls' AS type, CAST(id AS VARCHAR) AS id, string_agg(url, ',' ORDER BY url) AS detail FROM (SELECT DISTINCT id, unnest(article_urls) AS url FROM hotspot)
        WHERE url NOT IN (SELECT url FROM article WHERE language <> 'de') GROUP BY id
      UNION ALL SELECT 'invalid_entity_format', CAST(id AS VARCHAR), 'entities are not a list' FROM hotspot WHERE id % 7 = 0
      UNION ALL SELECT 'mixed_languages', '', 'en,es,fr'""",
    "hotspot article",
)
def _(t: Tables):
    return quality.consistency_issues(t.hotspot(), t.article().where("language <> 'de'"))


def _outputs(t: Tables):
    k = F.col("event_type")
    return t.agent_log().select(
        F.concat("agent", F.lit("-"), F.col("pos").cast("string")).alias("agent"), "status",
        F.when(F.col("pos") % 50 == 0, "{}").when(F.col("pos") % 50 == 1, '{"note": "top secret"}').otherwise(F.col("props")).alias("output"),
        "execution_time",
    )


@query(
    "ag32_output_flags",
    """SELECT agent || '-' || pos AS agent, 'quality_issue' AS kind, 'empty_or_failed_output' AS issue, 'high' AS severity FROM agent_log WHERE status = 'failed'
      UNION ALL SELECT agent || '-' || pos, 'policy_violation', 'forbidden_keywords', 'medium' FROM agent_log WHERE pos % 50 = 1
      UNION ALL SELECT agent || '-' || pos, 'anomaly', 'long_execution_time', 'medium' FROM agent_log WHERE execution_time > 300""",
    "agent_log",
)
def _(t: Tables):
    return quality.output_flags(_outputs(t))


@query("ag32_overall_status", "SELECT CASE WHEN count(*) > 1 THEN 'policy_violation' ELSE 'healthy' END AS overall_status FROM events")
def _(t: Tables):
    return quality.overall_status(quality.output_flags(_outputs(t)))


@query(
    "ag33_context_summary",
    f"""WITH h AS (SELECT * FROM hotspot WHERE created_at >= {AS_OF_SQL} - INTERVAL 12 DAY ORDER BY created_at DESC, id LIMIT 100),
      d AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM h GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY day DESC) AS r FROM d),
      t AS (SELECT count(*) AS days, avg(n) FILTER (r <= 3) AS a, avg(n) FILTER (r > 3) AS b FROM r),
      th AS (SELECT theme, count(*) AS n FROM h JOIN (VALUES {', '.join(f"('{w}')" for w in THEMES)}) x(theme) ON contains(lower(title), theme) OR contains(lower(summary), theme) GROUP BY 1)
      SELECT (SELECT count(*) FROM h) AS total_hotspots, (SELECT theme FROM th ORDER BY n DESC, theme LIMIT 1) AS first_theme,
        CASE WHEN days < 4 THEN 'insufficient_data' WHEN a > b * 1.2 THEN 'increasing' WHEN a < b * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM t""",
    "hotspot",
)
def _(t: Tables):
    from tidewire.operators.memory import context_summary

    parts = context_summary(t.hotspot(), AS_OF, 12, THEMES)
    return parts["trend"].select("trend").withColumns(
        {
            "total_hotspots": parts["total"].select("n").scalar(),
            "first_theme": parts["themes"].limit(1).select("theme").scalar(),
        }
    )


@query(
    "ag34_domain_confidence",
    "SELECT id, CASE len(domains) WHEN 0 THEN 0.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM flashpoint",
    "flashpoint",
)
def _(t: Tables):
    return t.flashpoint().select("id", tx.domain_confidence(F.col("domains")).alias("confidence"))


@query(
    "ag35_verification",
    """WITH ev AS (SELECT event_id, 'http://src' || (event_id % 20) || '.example.com/' || (event_id % 900) AS url FROM (SELECT DISTINCT event_id FROM claim)),
      c AS (SELECT a.event_id, count(*) AS n FROM claim a JOIN claim b ON a.event_id = b.event_id AND a.claim_pos < b.claim_pos
        WHERE (a.verdict = 'true' AND b.verdict = 'false') OR (a.verdict = 'false' AND b.verdict = 'true') OR a.s = b.c GROUP BY 1),
      cf AS (SELECT event_id, count(*) AS claims, round(0.8 * avg(CASE WHEN verdict = 'true' THEN 1.0 ELSE 0 END) + 0.4 * avg(CASE WHEN verdict = 'uncertain' THEN 1.0 ELSE 0 END), 2) AS confidence FROM claim GROUP BY 1),
      ra AS (SELECT event_id, count(*) AS n FROM ev JOIN article USING (url) GROUP BY 1)
      SELECT ev.event_id, claims, confidence, coalesce(c.n, 0) AS contradictions, coalesce(ra.n, 0) AS related_articles FROM ev JOIN cf USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN ra USING (event_id)""",
    "claim article",
)
def _(t: Tables):
    claims = t.claim()
    e = F.col("event_id")
    url = F.concat(
        F.lit("http://src"), (e % 20).cast("string"), F.lit(".example.com/"), (e % 900).cast("string")
    )
    events = claims.select("event_id").distinct().withColumn("article_urls", F.array(url))
    related = resolve.related_articles(events, t.article().select("url", F.col("id").alias("article_id")))
    return stats.verification_table(events, claims, related, resolve.contradiction_counts(claims))


@query(
    "ag36_tracker_stats",
    """SELECT count(*) AS flashpoints, count(DISTINCT array_to_string(list_sort(list_transform(entities, lambda e: lower(trim(e)))), ',')) AS total_combinations,
        (SELECT count(DISTINCT lower(trim(e))) FROM (SELECT unnest(entities) AS e FROM flashpoint)) AS total_entities FROM flashpoint""",
    "flashpoint",
)
def _(t: Tables):
    return stats.tracker_stats(t.flashpoint(), dedup.combo_key(F.col("entities")))


@query(
    "ag37_fetch_stats",
    "SELECT source AS query, count(*) AS total, count_if(title <> '' AND id % 7 <> 0) AS valid, count_if(NOT (title <> '' AND id % 7 <> 0)) AS invalid FROM article GROUP BY 1",
    "article",
)
def _(t: Tables):
    url = F.when(F.col("id") % 7 == 0, F.lit("ftp://x/y")).otherwise(F.col("url"))
    return stats.fetch_stats(t.article().select(F.col("source").alias("query"), "title", url.alias("url")))
