"""State across batches: every file is one batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.session import shared_folder
from tidewire.streaming import flows

T0 = datetime(2024, 1, 1)


def source(spark, batches, schema):
    path = shared_folder(spark, "t-stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def collect(spark, stream, mode="append"):
    out = shared_folder(spark, "t-out")
    flows.run_available(stream, out, shared_folder(spark, "t-state"), mode)
    return spark.read.schema(stream.schema).parquet(out)


def test_request_decisions_keep_state(spark):
    schema = "client string, pos long, ts timestamp"
    rows = [("a", i, T0 + timedelta(seconds=10 * i)) for i in range(12)]
    got = collect(spark, flows.request_decisions(source(spark, [rows[:5], rows[5:]], schema), 60, 3))
    allowed = {r["pos"]: r["allowed"] for r in got.collect()}
    taken, want = [], {}
    for _, p, ts in rows:
        taken = [t for t in taken if (ts - t).total_seconds() <= 60]
        want[p] = len(taken) < 3
        if want[p]:
            taken.append(ts)
    assert allowed == want


def test_last_word_on_a_topic_wins(spark):
    schema = "client string, ts timestamp, pos long, type string, topics array<string>, filters string"
    b1 = [("a", T0, 0, "subscribe", ["x", "y"], None), ("b", T0, 1, "subscribe", ["x"], None)]
    b2 = [("a", T0 + timedelta(seconds=1), 2, "unsubscribe", ["x"], None), ("a", T0, 3, "ping", [], None)]
    out = shared_folder(spark, "t-out")
    stream = flows.subscriptions_state(source(spark, [b1, b2], schema))
    flows.run_available(stream, out, shared_folder(spark, "t-state"), "update")
    rows = spark.read.parquet(out).collect()
    latest = {}
    for r in sorted(rows, key=lambda r: r["batch"]):
        latest[(r["client"], r["topic"])] = r["op"]
    assert latest == {("a", "x"): "unsubscribe", ("a", "y"): "subscribe", ("b", "x"): "subscribe"}


def test_urls_once_across_batches(spark):
    schema = "url string, published_at timestamp"
    b1 = [("u1", T0), ("u1", T0), ("u2", T0)]
    b2 = [("u1", T0 + timedelta(minutes=5)), ("u3", T0)]
    got = collect(spark, flows.once_per_url(source(spark, [b1, b2], schema)))
    assert sorted(r["url"] for r in got.collect()) == ["u1", "u2", "u3"]


def test_sessions_close_after_idle_time(spark):
    schema = "client string, ts timestamp"
    b1 = [("a", T0), ("a", T0 + timedelta(minutes=10))]
    b2 = [("a", T0 + timedelta(hours=5))]
    b3 = [("b", T0 + timedelta(hours=9))]
    got = collect(spark, flows.idle_sessions(source(spark, [b1, b2, b3], schema))).collect()
    first = min(got, key=lambda r: r["opened_at"])
    assert (first["client"], first["n"], first["closed_at"]) == ("a", 2, T0 + timedelta(minutes=40))


def test_handlers_see_their_type(spark):
    seen = []
    handlers = flows.EventHandlers()
    handlers.add("x", lambda rows, b: seen.append(("x", rows.count())))
    stream = source(spark, [[("x", 1), ("y", 2), ("x", 3)]], "event_type string, v long")
    flows.run_available(stream, "", shared_folder(spark, "t-state"), each=handlers)
    assert seen == [("x", 2)]
