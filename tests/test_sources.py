from datetime import datetime

from pyspark.sql import functions as F

from tidewire.session import shared_folder
from tidewire.sources import dims, landed, sinks

AS_OF = datetime(2024, 1, 31)
RSS = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>First &amp; best</title><description>d1</description><link>http://a/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Second</title><link>http://a/2</link><source url="http://s">Paper</source></item>
</channel></rss>"""


def write(spark, path, text):
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs)
    out.write(bytearray(text.encode()))
    out.close()


def test_rss(spark):
    path = shared_folder(spark, "t-rss")
    write(spark, f"{path}/a.xml", RSS)
    got = landed.read_rss(spark, path, AS_OF).orderBy("pos").collect()
    assert [r["title"] for r in got] == ["First & best", "Second"]
    assert got[0]["source"] == "Google News"
    assert got[0]["published_at"] == datetime(2024, 1, 15, 10) and got[1]["published_at"] == AS_OF
    assert landed.read_rss(spark, path, AS_OF, per_feed=1).count() == 1


def test_article_list(spark):
    path = shared_folder(spark, "t-list")
    write(spark, f"{path}/a.json", '{"articles":[{"seendate":"20240115103000","url":"u1","nummentions":5,"avgtone":-0.2},{"seendate":"bad","url":"u2"},{"seendate":"20240116000000","url":"u3"}]}')
    got = landed.article_list_events(landed.read_article_list(spark, path)).orderBy("event_time").collect()
    assert [(r["source_url"], r["num_mentions"], r["avg_tone"]) for r in got] == [("u1", 5, -0.2), ("u3", 0, 0.0)]


def test_multi_line_flashpoints(spark):
    path = shared_folder(spark, "t-fp")
    write(spark, f"{path}/a.json", '[\n {"title": "T", "description": "D", "entities": ["A", "B"], "domains": null}\n]')
    assert landed.read_flashpoints(spark, path).first()["entities"] == ["A", "B"]


def test_day_replace_is_idempotent_and_prunes(spark):
    path = shared_folder(spark, "t-day")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, d string").withColumn("dt", F.to_date("d"))
    sinks.replace_day(df, path)
    sinks.replace_day(df.where("id = 2").withColumn("id", F.lit(7).cast("long")), path)
    sinks.replace_day(df.where("id = 2").withColumn("id", F.lit(7).cast("long")), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 7]
    day = landed.read_day(spark, path, "2024-01-02")
    assert "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in day.collect()] == [7]


def test_apply_changes(spark):
    s = "id long, title string, updated_at timestamp"
    base = spark.createDataFrame([(1, "a", datetime(2020, 1, 1)), (2, "b", datetime(2020, 1, 1))], s)
    ch = spark.createDataFrame([(1, None, None, "upsert"), (2, None, None, "delete"), (3, "c", None, "upsert")], s + ", op string")
    got = {r["id"]: (r["title"], r["updated_at"]) for r in sinks.apply_changes(base, ch, AS_OF).collect()}
    assert got == {1: ("a", AS_OF), 3: ("c", AS_OF)}


def test_dimensions_are_small_and_broadcast(spark):
    rows = spark.range(10).select(F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("language"))
    plan = rows.join(dims.model_codes(spark), "language")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert dims.in_region(dims.countries(spark), "Africa").count() == 5
    assert dims.speaking(dims.countries(spark), "fr").count() == 4


def test_store_day_keeps_twins_apart_and_clears_the_day(spark, tmp_path):
    from datetime import datetime

    from tidewire.plans.daily import store_day

    schema = "flashpoint_id long, title string, description string, entities array<string>, domains array<string>"
    fp = spark.createDataFrame([(1, "Same", "a", None, None), (2, " Same", "b", ["x"], None)], schema)
    feeds = spark.createDataFrame(
        [(1, "u1", "t", "s", "d", "en", "", ""), (2, "u2", "t", "s", "d", "en", "", ""), (9, "u3", "t", "s", "d", "en", "", "")],
        "flashpoint_id long, url string, title string, seendate string, domain string, language string, sourcecountry string, description string",
    )
    day, path = datetime(2024, 1, 31), str(tmp_path / "day")
    out = store_day(fp, feeds, "r", day, path)
    parents, children = spark.read.parquet(out["flashpoint"]), spark.read.parquet(out["feed"])
    assert parents.select("id").distinct().count() == 2 and children.count() == 2
    assert children.join(parents.select(F.col("id").alias("flashpoint_id")), "flashpoint_id").count() == 2
    store_day(fp, feeds, "r", datetime(2024, 1, 30), path)
    store_day(fp.where("1 = 0"), feeds.where("1 = 0"), "r", day, path)
    assert [str(r.dt) for r in spark.read.parquet(out["flashpoint"]).select("dt").distinct().collect()] == ["2024-01-30"]
