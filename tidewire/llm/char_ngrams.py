"""Interpolated modified Kneser-Ney over the characters of whole texts; count tables grow with the text, joined by key.

An n-gram of up to five code points is two longs: ``hi`` has the first two characters, ``lo`` the last three, 21
bits each; shorter ones have zeros in front. So n-grams are exact and of any script.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.tokens import give_back
from tidewire.session import cut_lineage

#: Characters of an n-gram; bits of a character; what stands before and after a text (code points follow).
ORDER, BITS, BEGIN, END, FIRST = 5, 21, 1, 2, 3
#: N-grams of the model that all tasks hold: the commonest ones, at most so many. The others are joined by key.
HEAD = 1 << 21
#: Characters worked on together; n-grams looked up together.
CHUNK, BLOCK = 1 << 19, 1 << 16
_ONE, _TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(numbers of texts, their codes), some at a time: each piece has ORDER - 1 codes before those it predicts."""
    numbers, codes, size = [], [], 0
    for number, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32) + FIRST
        whole = np.concatenate([np.full(ORDER - 1, BEGIN, np.int32), points, np.array([END], np.int32)])
        for at in range(0, len(whole) - ORDER + 1, CHUNK):
            piece = whole[at : at + CHUNK + ORDER - 1]
            if codes and size + len(piece) > CHUNK:
                yield numbers, codes
                numbers, codes, size = [], [], 0
            numbers.append(number)
            codes.append(piece)
            size += len(piece)
    if codes:
        yield numbers, codes


def _distinct(codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(at, hi, lo, which): distinct n-grams that end at some of the places, and the number of each place's."""
    low = int(at[0]) - ORDER + 1
    here = codes[low : int(at[-1]) + 1]
    present = np.zeros(int(here.max()) + 1, bool)
    present[here] = True
    alphabet = np.flatnonzero(present)
    if len(alphabet) > 4096:
        # Twelve bits a character make one long; fewer places have fewer characters.
        yield from _distinct(codes, at[: len(at) // 2])
        yield from _distinct(codes, at[len(at) // 2 :])
        return
    number = np.zeros(len(present), np.int16)
    number[alphabet] = np.arange(len(alphabet))
    local, rel = number[here], at - int(at[0])
    key = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        key <<= 12
        key |= local[rel + k]
    del here, present, number, local, rel
    key, which = np.unique(key, return_inverse=True)
    c = [alphabet[key >> 12 * (ORDER - 1 - k) & 4095].astype(np.int64) for k in range(ORDER)]
    hi, lo = c[0] << BITS | c[1], c[2] << 2 * BITS | c[3] << BITS | c[4]
    # What asks for the n-grams needs memory of its own.
    del key, c
    yield at, hi, lo, which


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number of each place, hi, lo, which) for all places of the texts."""
    for numbers, codes in _pieces(texts):
        sizes = np.array([len(c) for c in codes])
        owner = np.repeat(numbers, sizes)
        predicted = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER - 1
        whole = np.concatenate(codes)
        for at, hi, lo, which in _distinct(whole, np.flatnonzero(predicted)):
            yield owner[at], hi, lo, which


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, hi, lo, which in _grams([t for t in batch.column("text").to_pylist() if t]):
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.bincount(which))], names=["hi", "lo", "c"])
    give_back()


def _shorter(hi: Column, lo: Column, order: int) -> tuple[Column, Column]:
    """The n-gram of ``order`` without its first character."""
    zero = F.lit(0).cast("long")
    keep = {5: (hi.bitwiseAND(_ONE), lo), 4: (zero, lo), 3: (zero, lo.bitwiseAND(_TWO)), 2: (zero, lo.bitwiseAND(_ONE))}
    return keep[order]


def _context(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The n-gram without its last character."""
    return F.shiftright(hi, BITS), F.shiftleft(hi.bitwiseAND(_ONE), 2 * BITS).bitwiseOR(F.shiftright(lo, BITS))


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Of n-grams seen once, twice and more often, from how many are seen one to four times."""
    n1, n2, n3, n4 = (max(float(n), 0.5) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    # Clipped, as small corpora can give discounts outside what a count can lose.
    return (
        min(max(1 - 2 * y * n2 / n1, 0.1), 0.9),
        min(max(2 - 3 * y * n3 / n2, 0.1), 1.8),
        min(max(3 - 4 * y * n4 / n3, 0.1), 2.7),
    )


@dataclass
class CharModel:
    """Gains (hi, lo, gain, seen) and the log-probability of a character never seen.

    The log-probability of a text is that of as many unseen characters, plus the gain of each n-gram in it: what
    the n-gram adds to its shorter one, and what it leaves as a context to shorter ones. ``begin`` is what the
    contexts before the first character leave.
    """

    gains: DataFrame
    unseen: float
    begin: float
    entries: int
    head: int = HEAD
    #: The head, once it is sent to the tasks.
    shared: Broadcast | None = None


def train(trusted: DataFrame, head: int = HEAD) -> CharModel:
    """Count all of the texts (column text) and build the model; no text gives no gains.

    Tasks count their texts before the shuffle. A context or ending of an n-gram has at most as many rows
    as there are characters, so no key of the joins is hot.
    """
    counts = trusted.mapInArrow(_count, "hi long, lo long, c long")
    tables = [cut_lineage(counts.groupBy("hi", "lo").agg(F.sum("c").alias("c")).withColumn("seen", F.col("c")))]
    for order in range(ORDER, 1, -1):
        hi, lo = _shorter(F.col("hi"), F.col("lo"), order)
        # Orders below the highest count in how many ways an n-gram is preceded.
        shorter = tables[-1].select(hi.alias("hi"), lo.alias("lo"), "seen")
        tables.append(cut_lineage(shorter.groupBy("hi", "lo").agg(F.count("*").alias("c"), F.sum("seen").alias("seen"))))
    tables = tables[::-1]
    total, size = tables[0].agg(F.sum("c"), F.count("*")).first()
    few = [t.where("c <= 4").groupBy(F.lit(n).alias("order"), "c").agg(F.count("*").alias("n")) for n, t in enumerate(tables, start=1)]
    times = {(r.order, r.c): r.n for r in reduce(DataFrame.unionByName, few).collect()}
    gains, lower, unseen = [], None, 0.0
    for order, table in enumerate(tables, start=1):
        d = _discounts(*[times.get((order, c), 0) for c in (1, 2, 3, 4)])
        lost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = table.withColumn("lost", lost)
        if order == 1:
            spare = rows.agg(F.sum("lost")).first()[0] / total if size else 1.0
            unseen = math.log(spare / ((size or 0) + 1))
            p = cut_lineage(rows.select("hi", "lo", "seen", ((F.col("c") - F.col("lost")) / F.lit(total or 1) + F.lit(math.exp(unseen))).alias("p")))
            gains.append(p.select("hi", "lo", (F.log("p") - F.lit(unseen)).alias("gain"), "seen"))
        else:
            up, left = _context(F.col("hi"), F.col("lo"))
            short = _shorter(F.col("hi"), F.col("lo"), order)
            rows = rows.withColumns({"_ch": up, "_cl": left, "_sh": short[0], "_sl": short[1]})
            sums = rows.groupBy("_ch", "_cl").agg((F.sum("lost") / F.sum("c")).alias("spare"), F.sum("c").alias("total"))
            below = lower.select(F.col("hi").alias("_sh"), F.col("lo").alias("_sl"), F.col("p").alias("below"))
            joined = rows.join(sums, ["_ch", "_cl"]).join(below, ["_sh", "_sl"])
            own = (F.col("c") - F.col("lost")) / F.col("total")
            p = cut_lineage(joined.select("hi", "lo", "seen", "spare", "below", (own + F.col("spare") * F.col("below")).alias("p")))
            gains.append(p.select("hi", "lo", (F.log("p") - F.log("spare") - F.log("below")).alias("gain"), "seen"))
            gains.append(sums.select(F.col("_ch").alias("hi"), F.col("_cl").alias("lo"), F.log("spare").alias("gain"), F.lit(0).cast("long").alias("seen")))
        lower = p
    every = reduce(DataFrame.unionByName, gains)
    # An n-gram has one gain as such and one as a context.
    table = cut_lineage(every.groupBy("hi", "lo").agg(F.sum("gain").alias("gain"), F.max("seen").alias("seen")))
    starts, hi, lo = [], 0, 0
    for _ in range(ORDER - 1):
        hi, lo = (hi << BITS | lo >> 2 * BITS) & _TWO, (lo << BITS | BEGIN) & ((1 << 3 * BITS) - 1)
        starts.append((hi, lo))
    is_start = F.lit(False)
    for hi, lo in starts:
        is_start |= (F.col("hi") == hi) & (F.col("lo") == lo)
    entries, begin = table.agg(F.count("*"), F.sum(F.when(is_start, F.col("gain")))).first()
    return CharModel(table, unseen, begin or 0.0, entries, head)


def _hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    x = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(31)) * np.uint64(0x165667B19E3779F9)


class Lookup:
    """Gains of n-grams by their sorted hashes of 64 bits."""

    def __init__(self, key: np.ndarray, gain: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, self.gain = key[order], gain[order]

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gain, found) of each n-gram; the gain of what is not found is zero."""
        if not len(self.key):
            return np.zeros(len(hi)), np.zeros(len(hi), bool)
        key = _hash(hi, lo)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[at] == key
        return np.where(found, self.gain[at], 0.0), found


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = _hash(b.column("hi").to_numpy(), b.column("lo").to_numpy()).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column("gain")], names=["key", "gain"])


def lookup_of(gains: DataFrame) -> Lookup:
    """All rows of ``gains``, of which there are as many as a head has at most."""
    rows = gains.select("hi", "lo", "gain").mapInArrow(_keyed, "key long, gain double").toArrow()
    return Lookup(rows.column("key").to_numpy().view(np.uint64), rows.column("gain").to_numpy())


def _orders(hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """An n-gram and its endings of all orders."""
    none = np.zeros_like(hi)
    yield from ((hi, lo), (hi & _ONE, lo), (none, lo), (none, lo & _TWO), (none, lo & _ONE))


def _sums(lookup: Lookup, hi: np.ndarray, lo: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The gains of each n-gram's orders together, and where there is ``more`` which orders are not found."""
    sums, missing = np.zeros(len(hi)), np.zeros((ORDER, len(hi)), bool) if more else None
    for at in range(0, len(hi), BLOCK):
        part = slice(at, at + BLOCK)
        for k, (h, l) in enumerate(_orders(hi[part], lo[part])):
            gain, found = lookup.find(h, l)
            sums[part] += gain
            if more:
                missing[k, part] = ~found
    return sums, missing


def score_texts(texts: list[str], lookup: Lookup, more: bool) -> tuple[np.ndarray, list[list[dict]]]:
    """Sums of the gains found, per text, and where there is ``more`` the other n-grams of each text with counts."""
    gains = np.zeros(len(texts))
    rest: list[list[dict]] = [[] for _ in texts]
    for owner, hi, lo, which in _grams(texts):
        sums, missing = _sums(lookup, hi, lo, more)
        gains += np.bincount(owner, sums[which], len(texts))
        if more:
            pairs, n = np.unique(np.stack([owner, which]), axis=1, return_counts=True)
            for (h, l), absent in zip(_orders(hi, lo), missing):
                asked = absent[pairs[1]]
                for o, w, k in zip(pairs[0][asked].tolist(), pairs[1][asked].tolist(), n[asked].tolist()):
                    rest[o].append({"hi": int(h[w]), "lo": int(l[w]), "n": k})
    return gains, rest


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(7)).alias("b"))


def with_surprise(docs: DataFrame, model: CharModel) -> DataFrame:
    """Add surprise: the mean negative log-probability per character of the column text; null for null and empty ones.

    The commonest n-grams of the model, up to its ``head``, are looked up where the text is. The texts'
    n-grams beyond them are counted per text and joined with the rest of the table, so a key that many texts share
    is never shuffled. As long as the head is the whole table there is no rest and no shuffle.
    """
    order = [F.desc("seen"), "hi", "lo"]
    more = model.entries > model.head
    top = model.gains.orderBy(*order).limit(model.head) if more else model.gains
    if model.shared is None:
        model.shared = docs.sparkSession.sparkContext.broadcast(lookup_of(top))
    shared = model.shared

    @F.pandas_udf("struct<gain: double, rest: array<struct<hi: long, lo: long, n: long>>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            gains, rest = score_texts(texts.tolist(), shared.value, more)
            yield pd.DataFrame({"gain": gains, "rest": rest})
        give_back()

    whole = F.coalesce("text", F.lit(""))
    places = F.length(whole) + 1
    held = docs.withColumn("_scored", scored(whole))
    if not more:
        total = F.col("_scored.gain")
        return held.withColumn("surprise", _surprise(model, total, places)).drop("_scored")
    place = F.struct((-F.col("seen")).alias("seen"), "hi", "lo")
    last = top.agg(F.max(place)).first()[0]
    beyond = place > F.struct(*[F.lit(x).cast("long").alias(c) for c, x in last.asDict().items()])
    rest = model.gains.where(beyond).select("hi", "lo", F.col("gain").alias("_gain"))
    texts = held.where("text is not null and text != ''").select(text_key(F.col("text")).alias("_row"), F.col("_scored.rest").alias("rest"))
    keyed = cut_lineage(texts.dropDuplicates(["_row"])).select("_row", F.explode("rest").alias("g")).select("_row", "g.*")
    sums = keyed.join(rest, ["hi", "lo"]).groupBy("_row").agg(F.sum(F.col("n") * F.col("_gain")).alias("_more"))
    joined = held.withColumn("_row", text_key(whole)).join(sums, "_row", "left")
    total = F.col("_scored.gain") + F.coalesce("_more", F.lit(0.0))
    return joined.withColumn("surprise", _surprise(model, total, places)).drop("_scored", "_row", "_more")


def _surprise(model: CharModel, gain: Column, places: Column) -> Column:
    found = -(F.lit(model.unseen) + (gain + F.lit(model.begin)) / places)
    return F.when(F.coalesce("text", F.lit("")) != "", found)
