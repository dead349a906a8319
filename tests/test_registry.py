"""The contract of the registered queries, and a sample of them against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "ag05_geo_patterns", "ag35_verification", "dd03_greedy_near_duplicates", "dd04_similar_texts",
    "dd07_cluster_flashpoints", "flt10_near", "jn05_entity_combinations", "jn08_query_history",
    "scl12_keywords", "src01_rss_articles", "snk01_daily_replace", "str06_subscriptions",
    "wn01_trend_direction", "wn03_window_decisions", "vec02_top_per_query",
)

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(rel.fetchall(), rel.columns)
