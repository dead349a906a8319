"""Periodic runs of words by an enhanced suffix array and the branching-tandem test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Words of a run, and times its period, at least.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Bytes of documents worked on together; a longer document is worked on alone. Suffixes listed at once.
TOGETHER, AT_ONCE = 1 << 21, 1 << 21


def suffix_ranks(words: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... words, up to where all ranks differ.

    ``words`` are numbers of the words of documents one after the other, ``docs`` the numbers of these
    documents, ascending. A rank is the place of the first equal item in sorted order; items of two documents,
    and items cut off by the document's end, are equal to none. The last array is the inverse suffix array.
    One -1 is added to each, for the place after the end.
    """
    n = len(words)
    order = np.lexsort((words, docs))
    first = np.r_[True, (words[order[1:]] != words[order[:-1]]) | (docs[order[1:]] != docs[order[:-1]])]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [rank]
    ends = np.searchsorted(docs, docs, side="right")
    alone = first & np.r_[first[1:], True]
    open_ = np.sort(order[~alone])
    width = 1
    while len(open_):
        rank = levels[-1].copy()
        after = open_ + width
        then = np.where(after < ends[open_], rank[np.minimum(after, n)], -1).astype(np.int64)
        key = rank[open_].astype(np.int64) * (n + 1) + (then + 1)
        by_key = np.argsort(key, kind="stable")
        open_, key = open_[by_key], key[by_key]
        group = key // (n + 1)
        place = np.arange(len(key))
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_key = np.r_[True, key[1:] != key[:-1]]
        inside = place - np.maximum.accumulate(np.where(new_group, place, 0))
        rank[open_] = np.maximum.accumulate(np.where(new_key, group + inside, 0))
        levels.append(rank)
        open_ = open_[~(new_key & np.r_[new_key[1:], True])]
        width *= 2
    return levels


def common_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Numbers of equal words from the places i and j on."""
    n, got = len(levels[0]) - 1, np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        got += (rank[np.minimum(i + got, n)] == rank[np.minimum(j + got, n)]).astype(np.int64) << k
    return got


def common_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Numbers of equal words before the places i < j."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, at = levels[k], i - got - (1 << k)
        same = (at >= 0) & (rank[np.maximum(at, 0)] == rank[np.maximum(at + j - i, 0)])
        got += same.astype(np.int64) << k
    return got


def _intervals(lcp: np.ndarray, p: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last rank of the LCP interval of depth lcp[p] around each boundary p, by minima over powers of two."""
    n, depth = len(lcp), lcp[p]
    minima = [lcp]
    while 2 << (len(minima) - 1) <= reach:
        last, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last[: len(last) - half], last[half:]))
    left, right = p.copy(), p.copy()
    for k in range(len(minima) - 1, -1, -1):
        low, top = minima[k], len(minima[k]) - 1
        at = left - (1 << k)
        left = np.where((at >= 1) & (low[np.clip(at, 0, top)] >= depth), at, left)
        ok = (right + (1 << k) < n) & (low[np.clip(right + 1, 0, top)] >= depth)
        right = np.where(ok, right + (1 << k), right)
    return left - 1, right


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose next word differs from the one a period before it.

    A square of period d at i is branching where the suffixes at i and i + d lie in different children of an
    LCP interval of depth d. Of each interval all children but a largest one are listed, and for their
    suffixes the ranks of i + d and i - d are looked up: inside the interval, outside the child.
    """
    isa = levels[-1]
    n = len(isa) - 1
    sa = np.empty(n, np.int64)
    sa[isa[:n]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    none = np.zeros(0, np.int64)
    if not len(near):
        return none, none
    lcp[near] = common_after(levels, sa[near - 1], sa[near])
    reach = int(np.bincount(levels[0][:n]).max())
    low, high = _intervals(lcp, near, reach)
    order = np.argsort(low * (n + 1) + high, kind="stable")
    p, low, high = near[order], low[order], high[order]
    opens = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    number = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    # Children in order: one before the first boundary of an interval, and one from each boundary on.
    at, before = np.arange(len(p)) + number + 1, heads + np.arange(len(heads))
    size = len(p) + len(heads)
    start, end, of = (np.empty(size, np.int64) for _ in range(3))
    start[at], start[before] = p, low[heads]
    end[at] = np.where(np.r_[opens[1:], True], high, np.r_[p[1:], 0] - 1)
    end[before] = p[heads] - 1
    of[at], of[before] = number, np.arange(len(heads))
    length = end - start + 1
    largest = np.flatnonzero(length == np.maximum.reduceat(length, before)[of])
    largest = largest[np.r_[True, of[largest[1:]] != of[largest[:-1]]]]
    small = np.ones(size, bool)
    small[largest] = False
    small = np.flatnonzero(small)
    depth, low, high = lcp[p[heads]], low[heads], high[heads]
    found = []
    cuts = np.searchsorted(np.cumsum(length[small]), np.arange(AT_ONCE, length[small].sum() + AT_ONCE, AT_ONCE), side="left") + 1
    for part in np.split(small, cuts[cuts < len(small)]):
        child = np.repeat(part, length[part])
        offset = np.arange(len(child)) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
        i, v = sa[start[child] + offset], of[child]
        for other, square in ((i + depth[v], i), (i - depth[v], i - depth[v])):
            r = np.where((other >= 0) & (other < n), isa[np.clip(other, 0, n)], -1)
            hit = (r >= low[v]) & (r <= high[v]) & ((r < start[child]) | (r > end[child]))
            found.append(square[hit] * (n + 1) + depth[v][hit])
    both = np.unique(np.concatenate(found)) if found else none
    return both // (n + 1), both % (n + 1)


def word_runs(words: np.ndarray, docs: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least ``least`` words and two periods, by start and period.

    Rotating a branching square to the left gives all squares of its run; the rotations end where the words
    before the two halves differ. Of squares with the same run the smallest period counts.
    """
    levels = suffix_ranks(words, docs)
    i, period = branching_squares(levels)
    turns = common_before(levels, i, i + period)
    start, length = i - turns, turns + 2 * period
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    if len(start):
        first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
        start, length, period = start[first], length[first], period[first]
        order = np.lexsort((period, start))
        start, length, period = start[order], length[order], period[order]
    return start, length, period


def _found(texts: list[bytes | None], least: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed texts of some documents."""
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(ws) for ws in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], np.int64)
    docs = np.repeat(np.arange(len(split)), sizes)
    runs: list[list[dict]] = [[] for _ in split]
    if not len(words):
        return runs, [b"" for _ in split]
    start, length, period = word_runs(words, docs, least)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    keep = np.cumsum(depth)[:-1] == 0
    for s, m, q in zip(start.tolist(), length.tolist(), period.tolist()):
        d = int(docs[s])
        runs[d].append({"start": s - int(starts[d]), "length": m, "period": q})
    collapsed = []
    for d, ws in enumerate(split):
        if runs[d]:
            own = keep[starts[d] : starts[d] + sizes[d]]
            ws = [w for w, k in zip(ws, own.tolist()) if k]
        collapsed.append(b" ".join(ws))
    return runs, collapsed


def _parts(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """The texts in order, some at a time."""
    part, size = [], 0
    for t in texts:
        own = len(t) if t else 0
        if part and size + own > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += own
    if part:
        yield part


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Add runs (array of start, length, period, in words) and collapsed (string) to the rows of ``docs``.

    Words are what ASCII white space leaves; null is an empty text. A run is a stretch of words with smallest
    period q and at least ``least`` and 2 q words that no neighbouring word extends. ``collapsed`` has the words that
    are in no run after its first period, joined by one blank. Rows are independent: there is no shuffle, and a
    row takes memory in proportion to its words and the logarithm of its longest repeat. Columns of ``docs``
    named runs or collapsed are replaced.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    if text not in kept:
        raise ValueError(f"no column {text}")
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for part in _parts(batch.column(text).cast(pa.binary()).to_pylist()):
                r, c = _found(part, least)
                runs += r
                collapsed += c
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(runs, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "runs", "collapsed"])

    return docs.select(*kept).mapInArrow(work, schema)
