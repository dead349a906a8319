"""Request limits: sliding window, minimum interval, paging."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewire.operators.scans import earlier
from tidewire.session import cut_lineage

BLOCK_ROWS = 50_000  # a burst of fewer requests is replayed as one block


def window_counts(
    requests: DataFrame, client: str = "client", ts: str = "ts", tie: str = "pos",
    seconds: int = 60, limit: int = 1000,
) -> DataFrame:
    """Requests of the same client in the last ``seconds``, counted for every request.

    Adds ``in_window`` (with the request itself), ``remaining``, ``oldest`` and
    ``within_limit``. Every row is sent to its own time bucket and, as history,
    to the next one, so a busy client is spread over its buckets.
    """
    t = F.col(ts).cast("double")
    bucket = F.floor(t / seconds).cast("long")
    copies = requests.withColumn("_t", t).withColumn(
        "_copy",
        F.explode(
            F.array(
                F.struct(bucket.alias("b"), F.lit(True).alias("own")),
                F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")),
            )
        ),
    ).select(*requests.columns, "_t", "_copy.b", "_copy.own")
    span = W.partitionBy(client, "b").orderBy("_t").rangeBetween(-seconds, W.currentRow)
    return (
        copies.withColumns(
            {"in_window": F.count("*").over(span), "oldest": F.min(ts).over(span)}
        )
        .where("own")
        .withColumns(
            {
                "remaining": F.greatest(F.lit(limit) - F.col("in_window"), F.lit(0)),
                "reset_at": F.timestamp_seconds(F.col("oldest").cast("double") + seconds),
                "within_limit": F.col("in_window") <= limit,
            }
        )
        .drop("_t", "b", "own", "oldest")
    )


def bursts(requests: DataFrame, client: str, ts: str, gap: float, width: int = 3600) -> DataFrame:
    """Add ``burst``: start (in microseconds) of the run of requests with gaps below ``gap`` seconds."""
    micros, step = F.col("_us"), int(width * 1e6)
    timed = requests.withColumn("_us", F.unix_micros(ts))
    prev = earlier(timed, [client], "_us", "_us", "max", "_prev", step)
    new = F.col("_prev").isNull() | (micros - F.col("_prev") >= gap * 1e6)
    starts = cut_lineage(prev.withColumn("_start", F.when(new, micros)))
    back = earlier(starts, [client], "_us", "_start", "max", "_last", step)
    return back.withColumn("burst", F.coalesce("_start", "_last")).drop(
        "_us", "_prev", "_start", "_last"
    )


def sliding_window_decisions(
    requests: DataFrame, client: str = "client", ts: str = "ts", tie: str = "pos",
    seconds: int = 60, limit: int = 1000, blocks: int = 64,
) -> DataFrame:
    """Exact decision per request: at most ``limit`` accepted ones in any window.

    Rejected requests use no quota, so decisions inside a busy stretch depend on
    each other. Stretches without any over-full window are accepted as a set;
    only the others are replayed, in up to ``blocks`` blocks of time each.
    """
    counted = cut_lineage(
        window_counts(requests.select(client, tie, ts), client, ts, tie, seconds, limit).drop(
            "remaining", "reset_at", "in_window"
        )
    )
    cut = cut_lineage(bursts(counted, client, ts, seconds))
    hot = cut.groupBy(client, "burst").agg(F.bool_or(~F.col("within_limit")).alias("hot"))
    marked = cut.join(hot, [client, "burst"]).drop("within_limit")
    calm = marked.where("not hot").select(client, tie, ts, F.lit(True).alias("allowed"))
    span = seconds * 1_000_000

    def forget(taken: deque, now: int) -> None:
        while taken and now - taken[0] > span:
            taken.popleft()

    def accept(taken: deque, now: int) -> bool:
        forget(taken, now)
        if len(taken) >= limit:
            return False
        taken.append(now)
        return True

    return calm.unionByName(_replayed(marked.where("hot"), accept, forget, client, ts, tie, span, blocks))


def min_interval_decisions(
    requests: DataFrame, per_minute: int, source: str = "source", ts: str = "ts", tie: str = "pos", blocks: int = 64,
) -> DataFrame:
    """Exact decision per request: at least ``60 / per_minute`` seconds since the last accepted one."""
    gap = 60.0 / per_minute
    cut = cut_lineage(bursts(cut_lineage(requests.select(source, tie, ts)), source, ts, gap))
    sizes = cut.groupBy(source, "burst").agg(F.count("*").alias("n"))
    marked = cut.join(sizes, [source, "burst"])
    calm = marked.where("n = 1").select(source, tie, ts, F.lit(True).alias("allowed"))

    def forget(last: deque, now: int) -> None:
        if last and now - last[0] >= gap * 1_000_000:
            last.clear()

    def accept(last: deque, now: int) -> bool:
        forget(last, now)
        if last:
            return False
        last.append(now)
        return True

    return calm.unionByName(
        _replayed(marked.where("n > 1"), accept, forget, source, ts, tie, int(gap * 1e6), blocks)
    )


Accept = Callable[[deque, int], bool]
Forget = Callable[[deque, int], None]


def _replayed(
    rows: DataFrame, accept: Accept, forget: Forget, key: str, ts: str, tie: str, span: int, blocks: int
) -> DataFrame:
    """Ask ``accept`` for every row of each burst in time order, a burst in blocks of time at once.

    The first round replays each block as if nothing had been accepted before it. A block hands the times
    that still count at its end to the next one, and each later round replays only the blocks to which other
    times came than those they were replayed with. A block's decisions stand when nothing new comes to it:
    after as many rounds as blocks at most, and after a few where decisions soon cease to depend on what was
    before. A block is read as a stream, and only its accepted times that still count are held.
    """
    ends = rows.groupBy(key, "burst").agg(F.max(F.unix_micros(ts)).alias("_end"), F.count("*").alias("_n"))
    parts = F.least(F.lit(blocks), F.ceil(F.col("_n") / BLOCK_ROWS))
    width = F.greatest(F.ceil((F.col("_end") - F.col("burst") + 1) / parts), F.lit(4 * span + 1)).cast("long")
    cut = cut_lineage(
        rows.join(ends.select(key, "burst", width.alias("_width")), [key, "burst"])
        .withColumn("_us", F.unix_micros(ts))
        .withColumn("_block", F.floor((F.col("_us") - F.col("burst")) / F.col("_width")).cast("int"))
        .withColumn("_to", F.col("burst") + (F.col("_block") + 1) * F.col("_width"))
        .select(key, "burst", "_block", "_to", tie, ts, "_us")
    )
    nothing = F.array().cast("array<long>")
    places = [key, "burst", "_block"]
    entries = cut.select(*places).distinct().withColumn("_entry", nothing)
    handed, done, number = None, [], 0
    while True:
        replayed = cut_lineage(_replay(cut, entries, accept, forget, key, ts, tie).withColumn("_round", F.lit(number)))
        done.append(replayed)
        latest = replayed.where("_exit IS NOT NULL").select(*places, "_entry", "_exit", "_round")
        if handed is not None:
            latest = _latest(handed.unionByName(latest), places)
        handed = cut_lineage(latest)
        before = F.lag("_exit").over(W.partitionBy(key, "burst").orderBy("_block"))
        now = handed.withColumn("_now", F.coalesce(before, nothing))
        changed = cut_lineage(now.where("_now != _entry").select(*places, F.col("_now").alias("_entry")))
        if changed.isEmpty():
            break
        entries, number = changed, number + 1
    standing = handed.select(*places, "_round")
    decisions = None
    for part in done:
        part = part.where("_exit IS NULL").join(standing, [*places, "_round"]).select(key, tie, ts, "allowed")
        decisions = part if decisions is None else decisions.unionByName(part)
    return decisions


def _latest(rounds: DataFrame, places: list[str]) -> DataFrame:
    newest = F.max_by(F.struct("_entry", "_exit", "_round"), "_round").alias("n")
    return rounds.groupBy(*places).agg(newest).select(*places, "n.*")


def _replay(
    cut: DataFrame, entries: DataFrame, accept: Accept, forget: Forget, key: str, ts: str, tie: str
) -> DataFrame:
    """Decisions of the rows of the blocks in ``entries``, and a row per block with its entry and exit times."""
    places = [key, "burst", "_block"]
    types = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    # The entry comes as the first row of its block, before every request.
    first = entries.join(cut.groupBy(*places).agg(F.min("_to").alias("_to")), places).select(
        *places, "_to", F.lit(None).cast(types[tie]).alias(tie), F.lit(None).cast(types[ts]).alias(ts),
        F.lit(None).cast("long").alias("_us"), "_entry",
    )
    asked = cut.join(entries.select(*places), places, "left_semi").withColumn("_entry", F.lit(None).cast("array<long>"))
    # By a hash of its own: for the keys of the joins above, Spark takes their partitions on both sides of the union for
    # the ones asked for and leaves out the shuffle, but adaptive execution cuts and joins those of each side on its own.
    ordered = (
        asked.unionByName(first)
        .withColumn("_home", F.xxhash64(*places))
        .repartition("_home")
        .drop("_home")
        .sortWithinPartitions(*places, F.asc_nulls_first("_us"), tie)
    )
    schema = (
        f"{key} {types[key]}, burst long, _block int, {tie} {types[tie]}, {ts} {types[ts]}, allowed boolean, "
        "_entry array<long>, _exit array<long>"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    at = {c: i for i, c in enumerate(ordered.columns)}

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = end = None
        entry, state = [], deque()

        def left() -> tuple:
            forget(state, end)
            return (*here, None, None, None, entry, list(state))

        out_schema = None
        for batch in batches:
            fields = {f.name: f.type for f in batch.schema}
            out_schema = pa.schema(
                [(n, pa.bool_() if n == "allowed" else fields["_entry" if n == "_exit" else n]) for n in names]
            )
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                now = row[at["_us"]]
                if now is None:
                    if here is not None:
                        rows.append(left())
                    here, end = tuple(row[at[c]] for c in places), row[at["_to"]]
                    entry, state = row[at["_entry"]], deque(row[at["_entry"]])
                else:
                    rows.append((*here, row[at[tie]], row[at[ts]], accept(state, now), None, None))
            yield _batch(rows, out_schema)
        if here is not None:
            yield _batch([left()], out_schema)

    return ordered.mapInArrow(replay, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def page(df: DataFrame, number: int, size: int = 50, created: str = "created_at", key: str = "id") -> DataFrame:
    """One page of the newest rows, each with the page facts.

    The rows come from a top-k plan, the total from a separate count.
    """
    if not 1 <= size <= 200 or number < 1:
        raise ValueError("page size is 1..200 and pages start at 1")
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(F.desc(created), key).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total") / size).cast("long")
    return rows.withColumn("total", total).withColumns(
        {
            "total_pages": pages,
            "has_next": F.lit(number) < pages,
            "has_prev": F.lit(number > 1),
        }
    )


def daily_trend(df: DataFrame, created: str = "created_at") -> DataFrame:
    """One row: direction of the daily counts, last three observed days against the earlier ones."""
    daily = df.groupBy(F.to_date(created).alias("day")).agg(F.count("*").alias("n"))
    ranked = daily.withColumn("r", F.row_number().over(W.orderBy(F.desc("day"))))
    recent = F.avg(F.when(F.col("r") <= 3, F.col("n")))
    before = F.avg(F.when(F.col("r") > 3, F.col("n")))
    a, b = F.col("recent_avg"), F.col("earlier_avg")
    enough = F.col("days") >= 4
    up, down = a > b * 1.2, a < b * 0.8
    trend = (
        F.when(F.col("days") == 0, "no_data").when(~enough, "insufficient_data")
        .when(up, "increasing").when(down, "decreasing").otherwise("stable")
    )
    conf = (
        F.when(~enough, 0.0).when(up | down, F.least(F.lit(0.9), F.abs(a - b) / b)).otherwise(0.5)
    )
    return ranked.agg(
        F.count("*").alias("days"), recent.alias("recent_avg"), before.alias("earlier_avg")
    ).select("days", trend.alias("trend"), F.round(conf, 2).alias("confidence"))


def within_days(df: DataFrame, as_of: datetime, days: int, created: str = "created_at") -> DataFrame:
    return df.where(F.col(created) >= F.lit(as_of) - F.make_dt_interval(F.lit(days)))
