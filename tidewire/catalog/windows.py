"""Windows, limits, paging and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.aggregates import RISK_SQL, _rounded, _trend_sql
from tidewire.catalog.base import AS_OF, AS_OF_SQL, CONFLICT, STAMP, Tables, joined, query, r8, stamp
from tidewire.operators import limits, scans, trends


@query(
    "wn01_trend_direction",
    """SELECT country, CASE WHEN late - early > 0.1 THEN 'increasing' WHEN early - late > 0.1 THEN 'decreasing' ELSE 'stable' END AS trend_direction FROM (
        SELECT country, avg(sentiment) FILTER (r <= n // 2) AS early, avg(sentiment) FILTER (r > n // 2) AS late FROM (
          SELECT country, sentiment, row_number() OVER (PARTITION BY country ORDER BY published_at, pos) AS r, count(*) OVER (PARTITION BY country) AS n FROM processed)
        GROUP BY country)""",
    "processed",
)
def _(t: Tables):
    return trends.trend_direction(t.processed())


@query(
    "wn02_daily_trend",
    """SELECT days, CASE WHEN days < 4 THEN 'insufficient_data' WHEN a > b * 1.2 THEN 'increasing' WHEN a < b * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend,
        round(CASE WHEN days < 4 THEN 0 WHEN a > b * 1.2 OR a < b * 0.8 THEN least(0.9, abs(a - b) / b) ELSE 0.5 END, 2) AS confidence FROM (
      SELECT count(*) AS days, avg(n) FILTER (r <= 3) AS a, avg(n) FILTER (r > 3) AS b FROM (
        SELECT n, row_number() OVER (ORDER BY day DESC) AS r FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM hotspot GROUP BY 1)))""",
    "hotspot",
)
def _(t: Tables):
    return limits.daily_trend(t.hotspot())


@query(
    "wn03_window_counts",
    f"""SELECT event_id, n AS in_window, greatest(2 - n, 0) AS remaining, n <= 2 AS within_limit, strftime(o + INTERVAL 3600 SECOND, {STAMP}) AS reset_at FROM (
        SELECT event_id, count(*) OVER w AS n, min(ts) OVER w AS o FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW))""",
)
def _(t: Tables):
    rows = limits.window_counts(t.request_log(), seconds=3600, limit=2)
    return rows.select(
        F.col("pos").alias("event_id"), "in_window", F.col("remaining").cast("long").alias("remaining"),
        "within_limit", stamp("reset_at").alias("reset_at"),
    )


@query(
    "wn03_window_decisions",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, i, event_id, true AS allowed, [ts] AS taken FROM r WHERE i = 1
        UNION ALL SELECT r.user_id, r.i, r.event_id, len(list_filter(f.taken, lambda x: r.ts - x <= INTERVAL 7200 SECOND)) < 2,
          CASE WHEN len(list_filter(f.taken, lambda x: r.ts - x <= INTERVAL 7200 SECOND)) < 2
            THEN list_append(list_filter(f.taken, lambda x: r.ts - x <= INTERVAL 7200 SECOND), r.ts) ELSE f.taken END
        FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
      SELECT event_id, allowed FROM f""",
)
def _(t: Tables):
    rows = limits.sliding_window_decisions(t.request_log(), seconds=7200, limit=2)
    return rows.select(F.col("pos").alias("event_id"), "allowed")


@query(
    "wn04_min_interval",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, i, event_id, true AS allowed, ts AS last FROM r WHERE i = 1
        UNION ALL SELECT r.user_id, r.i, r.event_id, r.ts - f.last >= INTERVAL 36000 SECOND, CASE WHEN r.ts - f.last >= INTERVAL 36000 SECOND THEN r.ts ELSE f.last END
        FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
      SELECT event_id, allowed FROM f""",
)
def _(t: Tables):
    rows = t.request_log().withColumnRenamed("client", "source")
    return limits.min_interval_decisions(rows, per_minute=60 / 36000).select(F.col("pos").alias("event_id"), "allowed")


@query(
    "wn05_page",
    """SELECT id, total, total_pages, 3 < total_pages AS has_next, true AS has_prev FROM (
        SELECT id, (SELECT count(*) FROM feed WHERE language = 'en') AS total, CAST(ceil((SELECT count(*) FROM feed WHERE language = 'en') / 50.0) AS BIGINT) AS total_pages
        FROM feed WHERE language = 'en' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100)""",
    "feed",
)
def _(t: Tables):
    rows = limits.page(t.feed().where("language = 'en'"), 3, 50)
    return rows.select("id", "total", "total_pages", "has_next", "has_prev")


@query(
    "wn06_top_per_group",
    """SELECT country, keyword, n, r AS rank FROM (SELECT country, keyword, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, keyword) AS r
        FROM (SELECT country, unnest(keywords) AS keyword FROM processed) GROUP BY 1, 2) WHERE r <= 5""",
    "processed",
)
def _(t: Tables):
    counts = (
        t.processed().select("country", F.explode("keywords").alias("keyword"))
        .groupBy("country", "keyword").agg(F.count("*").alias("n"))
    )
    return scans.top_k(counts, ["country"], 5, F.desc("n"), F.col("keyword")).withColumn("rank", F.col("rank").cast("long"))


@query(
    "srt01_relevance_order",
    "SELECT id, row_number() OVER (ORDER BY relevance DESC, quality DESC, pos) AS place FROM processed",
    "processed",
)
def _(t: Tables):
    from tidewire.operators.order import placed

    return placed(t.processed(), F.desc("relevance"), F.desc("quality"), F.col("pos")).select("id", "place")


@query(
    "srt02_trend_order",
    f"""SELECT topic, confidence, volume_trend, row_number() OVER (ORDER BY confidence DESC, volume_trend DESC, topic) AS place
      FROM ({_trend_sql(15, 9, "")})""",
    "processed",
)
def _(t: Tables):
    from tidewire.operators.order import placed

    found = _rounded(trends.topic_trends(t.processed(), AS_OF, 9, max_topics=15, min_confidence=None))
    return placed(found, *trends.trend_order()).select("topic", "confidence", "volume_trend", "place")


@query(
    "srt03_country_order",
    f"""SELECT country, risk_score, row_number() OVER (ORDER BY risk_score DESC, country) AS place
      FROM (SELECT country, round({RISK_SQL}, 8) AS risk_score FROM processed GROUP BY 1 HAVING count(*) >= 3)""",
    "processed",
)
def _(t: Tables):
    from tidewire.operators.order import placed

    found = trends.country_risk(t.processed(), conflict_words=CONFLICT).withColumn("risk_score", r8("risk_score"))
    return placed(found, *trends.risk_order()).select("country", "risk_score", "place")


@query(
    "srt04_newest",
    f"SELECT id, strftime(created_at, {STAMP}) AS created_at FROM hotspot ORDER BY hotspot.created_at DESC, id LIMIT 20 OFFSET 5",
    "hotspot",
)
def _(t: Tables):
    rows = t.hotspot().orderBy(F.desc("created_at"), "id").offset(5).limit(20)
    return rows.select("id", stamp("created_at").alias("created_at"))


@query(
    "srt06_priority_order",
    """SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, ts, event_id) AS place FROM events""",
)
def _(t: Tables):
    from tidewire.operators.order import placed

    p = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return placed(t.events(), p.desc(), F.col("ts"), F.col("event_id")).select("event_id", "place")
