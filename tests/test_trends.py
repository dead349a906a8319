import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import risk, trends
from tidewire.operators.scans import early_late_means

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "pos long, country string, published_at timestamp, sentiment double, relevance double, quality double, "
    "keywords array<string>, categories array<string>, entities array<struct<text:string,label:string>>"
)


def art(pos, sentiment=0.0, relevance=0.0, keywords=(), country="X", hours=0):
    return (pos, country, T0 + timedelta(hours=hours), sentiment, relevance, 0.5, list(keywords), ["conflict"], [])


def test_country_risk_case(spark):
    rows = [art(0, -0.5), art(1, -0.5), art(2, 0.1, 0.9), art(3, 0.1, 0.1, ["war"])]
    got = trends.country_risk(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["risk_score"] == pytest.approx(0.35)


def test_direction_case(spark):
    rows = [art(i, s, hours=i) for i, s in enumerate([0.0, 0.0, 0.3, 0.3])]
    assert trends.trend_direction(spark.createDataFrame(rows, SCHEMA)).first()["trend_direction"] == "increasing"


@pytest.mark.parametrize("width", [1800, 3600 * 5, 3600 * 10000])
def test_halves_equal_plain_split(spark, width):
    rnd = random.Random(7)
    rows = [
        art(i, rnd.choice([None, rnd.random()]), country=rnd.choice(["hot", "hot", "b", "c"]), hours=rnd.randrange(40))
        for i in range(150)
    ]
    got = {r["country"]: r for r in early_late_means(spark.createDataFrame(rows, SCHEMA), "country", "published_at", "sentiment", width=width).collect()}
    for c in ("hot", "b", "c"):
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))
        half = len(mine) // 2
        for part, name in ((mine[:half], "early_mean"), (mine[half:], "late_mean")):
            v = [r[3] for r in part if r[3] is not None]
            assert got[c][name] == (pytest.approx(sum(v) / len(v)) if v else None)


@pytest.mark.parametrize(
    "r,n,p",
    [(0.0, 20, 1.0), (0.5, 20, 0.0247659), (-0.3, 100, 0.00242458), (1.0, 10, 0.0)],
)
def test_pearson_p(r, n, p):
    assert trends.pearson_p(r, n) == pytest.approx(p, rel=1e-3)


def test_pearson_p_against_integration():
    """Two-sided tail of Student's t by direct integration."""
    import math

    import numpy as np

    for r, n in ((0.2, 15), (0.65, 30), (-0.05, 500)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        xs = np.linspace(0, t, 200001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        body = np.trapezoid(c * (1 + xs * xs / df) ** (-(df + 1) / 2), xs)
        assert trends.pearson_p(r, n) == pytest.approx(1 - 2 * body, abs=1e-8)


def test_correlations_need_ten_rows(spark):
    rows = [art(i, 0.1 * i, 0.05 * i + 0.1) for i in range(9)]
    assert trends.correlations(spark.createDataFrame(rows, SCHEMA)).count() == 0
    rows = [art(i, 0.1 * i, 0.05 * i + 0.1) for i in range(10)]
    got = trends.with_significance(trends.correlations(spark.createDataFrame(rows, SCHEMA))).collect()
    first = next(r for r in got if (r["variable1"], r["variable2"]) == ("sentiment", "relevance"))
    assert first["coefficient"] == pytest.approx(1.0) and first["significance"] == "high"
    flat = next(r for r in got if r["variable1"] == "entity_count")
    assert flat["coefficient"] is None and flat["significance"] == "low"


def test_risks_fire_and_rest(spark):
    now = T0 + timedelta(days=2)
    rows = [art(i, -0.9, 0.9, ["urgent"], hours=40) for i in range(6)]
    got = {r["risk_type"]: r["risk_level"] for r in risk.all_risks(spark.createDataFrame(rows, SCHEMA), now).collect()}
    assert got == {"sentiment_risk": "high", "geographic_risk": "medium", "temporal_risk": "medium", "content_risk": "high"}
    calm = [art(i, 0.5, 0.1, hours=1) for i in range(6)]
    assert risk.all_risks(spark.createDataFrame(calm, SCHEMA), now).count() == 0
    assert risk.all_risks(spark.createDataFrame([], SCHEMA), now).count() == 0


def test_topic_is_matched_as_substring(spark):
    rows = [art(i, 0.1, keywords=["war"], hours=i) for i in range(4)] + [art(9, 0.1, keywords=["software"])]
    got = trends.topic_trends(spark.createDataFrame(rows, SCHEMA), T0 + timedelta(days=1), min_confidence=None)
    assert {r["topic"]: r["article_count"] for r in got.collect()} == {"war": 5}


def test_overview_equals_the_parts(spark):
    now = T0 + timedelta(days=2)
    rows = [art(i, (i * 37 % 200 - 140) / 100, (i % 10) / 10, ["urgent" if i % 3 else "calm", "war"], hours=i % 60) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    place = F.when(F.col("pos") % 5 == 0, F.lit(None)).when(F.col("pos") % 5 == 1, "").when(F.col("pos") == 2, "rare").otherwise(F.concat(F.lit("c"), F.col("pos") % 5))
    df = df.withColumn("country", place)
    whole = risk.Overview(df, now)
    own = trends.country_risk(df).select(whole.country_risk().columns)
    assert own.count() == 3 and sorted(whole.country_risk().collect()) == sorted(own.collect())
    apart = risk.sentiment_risk(df).unionByName(risk.geographic_risk(df)).unionByName(risk.temporal_risk(df, now)).unionByName(risk.content_risk(df))
    assert sorted(whole.risks().collect()) == sorted(apart.collect())
    assert sorted(trends.correlation_rows(whole.totals()).collect(), key=str) == sorted(trends.correlations(df).collect(), key=str)
    none = risk.Overview(df.where("1 = 0"), now)
    assert none.totals().first()["article_count"] == 0 and none.country_risk().count() == 0 and none.risks().count() == 0


def test_report_reads_the_articles_once(spark, tmp_path):
    from tidewire.plans.report import report

    rows = [art(i, -0.5, 0.9, ["urgent", "war"], hours=i % 40) for i in range(30)]
    path = str(tmp_path / "articles")
    spark.createDataFrame(rows, SCHEMA).withColumn("categories", F.array(F.lit("x"))).write.parquet(path)
    parts = report(spark.read.parquet(path), T0 + timedelta(days=2))
    assert not any(path in f for part in parts.values() for f in part.inputFiles())
    got = parts["summary"].first()
    assert got["total_articles"] == 30 and got["top_categories"] == ["x"] and got["countries_analyzed"] == 1
    assert got["high_risks"] + got["medium_risks"] == parts["risks"].count() > 0
    assert parts["sentiment_histogram"].first()["n"] == 30 and parts["top_trends"].count() == parts["trends"].count() == 2
