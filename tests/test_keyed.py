"""Keyed tables: only touched buckets are rewritten, and repeated change sets replace themselves."""

from datetime import datetime, timedelta

from test_streaming import T0, source
from tidewire.session import shared_folder
from tidewire.sources import sinks
from tidewire.sources.keyed import KeyedTable, added_up, newest
from tidewire.streaming import flows


def table(spark, schema, keys, buckets=8):
    return KeyedTable(spark, shared_folder(spark, "t-keyed"), keys, spark.createDataFrame([], schema).schema, buckets)


def files(kept):
    return {f for f in kept.read().inputFiles()}


def test_untouched_buckets_keep_their_files(spark):
    schema = "id long, title string, summary string, updated_at timestamp"
    kept = table(spark, schema, ["id"])
    base = spark.createDataFrame([(i, f"t{i}", None, T0) for i in range(200)], schema)
    assert kept.change(0, base, lambda old, rows: rows) == list(range(8))
    before, parts = files(kept), kept.parts()
    now = datetime(2024, 2, 1)
    changes = spark.createDataFrame([(3, "new", None, None, "upsert"), (4, None, None, None, "delete"), (999, "more", "s", None, "upsert")], schema + ", op string")
    apply = lambda old, rows: sinks.apply_changes(old, rows, now)
    touched = kept.change(1, changes, apply)
    assert 1 <= len(touched) <= 3
    assert {b: v for b, v in kept.parts().items() if b not in touched} == {b: v for b, v in parts.items() if b not in touched}
    same = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert same and same <= files(kept) and not (before - same) & files(kept)
    whole = sorted(map(tuple, sinks.apply_changes(base, changes, now).collect()), key=str)
    assert sorted(map(tuple, kept.read().collect()), key=str) == whole
    # The same change set again, as after a failure between its two writes, changes nothing.
    kept.change(1, changes, apply)
    assert sorted(map(tuple, kept.read().collect()), key=str) == whole


def test_emptied_and_unknown_tables(spark):
    kept = table(spark, "id long, n long", ["id"], 2)
    assert kept.read().count() == 0 and kept.parts() == {}
    rows = spark.createDataFrame([(1, 1), (2, 1)], "id long, n long")
    assert kept.change(0, rows.where("1 = 0"), added_up(["id"], ["n"], [])) == []
    kept.change(1, rows, added_up(["id"], ["n"], []))
    kept.change(2, rows, added_up(["id"], ["n"], []))
    assert sorted(map(tuple, kept.read().collect())) == [(1, 2), (2, 2)]
    kept.change(3, rows, lambda old, new: old.where("1 = 0"))
    assert kept.read().count() == 0 and kept.parts() == {}
    kept.change(4, rows, added_up(["id"], ["n"], []))
    assert kept.read().count() == 2


def test_last_words_over_three_batches(spark):
    schema = "client string, ts timestamp, pos long, type string, topics array<string>, filters string"
    at = lambda s: T0 + timedelta(seconds=s)
    b1 = [("a", at(0), 0, "subscribe", ["x", "y"], None), ("b", at(0), 1, "subscribe", ["x"], None)]
    b2 = [("a", at(9), 2, "unsubscribe", ["x"], None), ("a", at(1), 3, "ping", [], None), ("b", at(5), 4, "update_filters", [], "f1")]
    # Late words lose, whatever batch they come in; equal times go by pos.
    b3 = [("a", at(5), 5, "subscribe", ["x"], None), ("b", at(4), 6, "update_filters", [], "f0"), ("c", at(3), 8, "subscribe", ["x"], None), ("c", at(3), 7, "unsubscribe", ["x"], None)]
    for view, keys, want in (
        (flows.subscription_words, ["client", "topic"], {("a", "x", "unsubscribe"), ("a", "y", "subscribe"), ("b", "x", "subscribe"), ("c", "x", "subscribe")}),
        (flows.filter_words, ["client"], {("b", "f1")}),
    ):
        stream = view(source(spark, [b1, b2, b3], schema))
        kept = KeyedTable(spark, shared_folder(spark, "t-keyed"), keys, stream.schema)
        query = flows.run_available(stream, "", shared_folder(spark, "t-state"), each=flows.into(kept, newest(keys, "ts", "pos")))
        assert {p["batchId"] for p in query.recentProgress} >= {0, 1, 2}
        assert not any(p["stateOperators"] for p in query.recentProgress)
        assert {tuple(r[: len(keys) + 1]) for r in kept.read().collect()} == want


def test_counters_and_rates_over_three_batches(spark):
    schema = "event_type string, client string, ts timestamp"
    batches = [[("k", c, T0 + timedelta(minutes=50 * b + i)) for i, c in enumerate(cs)] for b, cs in enumerate(["aab", "bc", "a"])]
    stream = source(spark, batches, schema)
    keys = ["event_type", "client"]
    kept = KeyedTable(spark, shared_folder(spark, "t-keyed"), keys, flows.client_activity(spark.createDataFrame([], schema)).schema)
    sink = flows.into(kept, added_up(keys, ["n"], ["last_event"]))
    flows.run_available(stream, "", shared_folder(spark, "t-state"), each=lambda rows, n: sink(flows.client_activity(rows), n))
    assert [tuple(r) for r in flows.service_counters(kept.read()).collect()] == [("k", 6, 3, T0 + timedelta(minutes=100))]
    rates = flows.request_rates(stream, 3600, 3600, "10 minutes")
    keys = ["client", "window_start"]
    kept = KeyedTable(spark, shared_folder(spark, "t-keyed"), keys, rates.schema)
    query = flows.run_available(rates, "", shared_folder(spark, "t-state"), "update", flows.into(kept, newest(keys, "n")))
    hour = lambda h: T0 + timedelta(hours=h)
    assert {tuple(r) for r in kept.read().collect()} == {("a", hour(0), 2), ("b", hour(0), 2), ("c", hour(0), 1), ("a", hour(1), 1)}
    # Windows that the watermark has passed leave the state.
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(rows) == 4 and rows[-1] == 1


def test_once_per_url_forgets_after_the_lateness(spark):
    schema = "url string, published_at timestamp"
    day = lambda d: T0 + timedelta(days=d)
    batches = [[("u1", day(0)), ("u2", day(0)), ("u1", day(0))], [("u2", day(1)), ("u3", day(1))], [("u4", day(9))], [("u4", day(9))]]
    stream = flows.once_per_url(source(spark, batches, schema), "2 days")
    out = shared_folder(spark, "t-out")
    query = flows.run_available(stream, out, shared_folder(spark, "t-state"))
    assert sorted(r["url"] for r in spark.read.schema(stream.schema).parquet(out).collect()) == ["u1", "u2", "u3", "u4"]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 3 and rows[-1] == 1
