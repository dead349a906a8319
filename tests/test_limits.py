import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from tidewire.operators import limits, scans

T0 = datetime(2024, 1, 1)


def requests(seed, n=300):
    rnd = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += rnd.choice((0.0, 0.5, 5, 10, 30, 100))
        out.append((i, "hot" if rnd.random() < 0.5 else f"c{rnd.randrange(4)}", T0 + timedelta(seconds=t)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_window_equals_loop(spark, seed):
    rows = requests(seed)
    df = spark.createDataFrame(rows, "pos long, client string, ts timestamp")
    taken, want = {}, {}
    for pos, c, ts in rows:
        q = taken.setdefault(c, deque())
        while q and (ts - q[0]).total_seconds() > 60:
            q.popleft()
        want[pos] = len(q) < 3
        if want[pos]:
            q.append(ts)
    got = limits.sliding_window_decisions(df, seconds=60, limit=3)
    assert {r["pos"]: r["allowed"] for r in got.collect()} == want
    counts = {r["pos"]: r["in_window"] for r in limits.window_counts(df, seconds=60, limit=3).collect()}
    for pos, c, ts in rows:
        assert counts[pos] == sum(c2 == c and 0 <= (ts - t2).total_seconds() <= 60 for _, c2, t2 in rows)


@pytest.mark.parametrize("choices", [(0.5,), (0.0, 7.0, 20.0, 30.0)])
def test_one_client_over_many_blocks(spark, monkeypatch, choices):
    """A client in one unbroken overload: its blocks are replayed until the times handed on stand."""
    monkeypatch.setattr(limits, "BLOCK_ROWS", 10)
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(500):
        t += rnd.choice(choices)
        rows.append((i, "hot" if i % 3 == 0 else f"c{i}", T0 + timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "pos long, client string, ts timestamp")
    taken, want = {}, {}
    for pos, c, ts in rows:
        q = taken.setdefault(c, deque())
        while q and (ts - q[0]).total_seconds() > 5:
            q.popleft()
        want[pos] = len(q) < 2
        if want[pos]:
            q.append(ts)
    got = limits.sliding_window_decisions(df, seconds=5, limit=2, blocks=12)
    assert {r["pos"]: r["allowed"] for r in got.collect()} == want


def test_min_interval_equals_loop(spark):
    rows = requests(3)
    df = spark.createDataFrame(rows, "pos long, source string, ts timestamp")
    last, want = {}, {}
    for pos, c, ts in rows:
        want[pos] = c not in last or (ts - last[c]).total_seconds() >= 20
        if want[pos]:
            last[c] = ts
    got = limits.min_interval_decisions(df, per_minute=3)
    assert {r["pos"]: r["allowed"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_earlier_equals_loop(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, rnd.randrange(50)])) for i in rnd.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["low"] for r in scans.earlier(df, ["k"], "o", "v", "min", "low", width).collect()}
    for k, o, _ in rows:
        before = [v for k2, o2, v in rows if k2 == k and o2 < o and v is not None]
        assert got[(k, o)] == (min(before) if before else None)


def test_page_facts(spark):
    rows = [(i, T0 + timedelta(days=i % 3)) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp")
    got = limits.page(df, 2, 3).collect()
    assert [r["id"] for r in got] == [4, 0, 3]
    assert {(r["total"], r["total_pages"], r["has_next"], r["has_prev"]) for r in got} == {(7, 3, True, True)}
    with pytest.raises(ValueError):
        limits.page(df, 1, 500)


@pytest.mark.parametrize(
    "counts,trend,conf",
    [([1, 1, 1, 3, 3, 3], "increasing", 0.9), ([2, 2, 2, 2], "stable", 0.5), ([1, 5], "insufficient_data", 0.0), ([4, 4, 1, 1, 1], "decreasing", 0.75)],
)
def test_daily_trend(spark, counts, trend, conf):
    rows = [(T0 + timedelta(days=d),) for d, n in enumerate(counts) for _ in range(n)]
    got = limits.daily_trend(spark.createDataFrame(rows, "created_at timestamp")).first()
    assert (got["trend"], got["confidence"]) == (trend, conf)


def test_entry_and_requests_meet_in_one_partition(spark):
    """The shuffle by block is real: Spark must not take the joins' partitions on both sides of the union for it,
    as adaptive execution may cut or put together those of either side on its own."""
    rows = [(f"c{i % 5}", 0, i % 3, 10**9, i, T0 + timedelta(seconds=i), i * 10**6) for i in range(60)]
    cut = spark.createDataFrame(rows, "source string, burst long, _block int, _to long, pos long, ts timestamp, _us long")
    entries = cut.selectExpr("source", "burst", "_block", "CAST(array() AS array<long>) AS _entry").distinct()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = limits._replay(cut, entries, lambda taken, now: True, lambda taken, now: None, "source", "ts", "pos")
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
        assert got.where("_exit IS NULL").count() == 60 and got.where("_exit IS NOT NULL").count() == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
