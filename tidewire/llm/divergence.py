"""Source divergence audit: term counts from packed, radix-sorted terms; distances between sources of a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.session import cut_lineage

#: Documents of a language that have a term, at least; what is added to each count; scale of shares; ranks of terms.
LEAST_DOCS, ADDED, SCALE, TERMS = 30, 5, 10**9, 50
#: Bytes of text brought into the order of owners, and counted together; rows of one shard of terms, sources of one
#: block, cells of a matrix.
HELD, TOGETHER, SHARD_ROWS, BLOCK, CELLS = 1 << 25, 1 << 22, 200_000, 256, 1 << 22

_LETTER = np.zeros(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(256):
    # Every byte of a character outside ASCII is 0x80 or more.
    _LETTER[_c] = chr(_c).isascii() and chr(_c).isalpha() or _c >= 0x80
    _LOWER[_c] = _c + 32 if 0x41 <= _c <= 0x5A else _c


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows of uint64 words, the first word weighs most; 16 bits a pass, which numpy sorts by radix."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _run_counts(new_term: np.ndarray, owner: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows of the runs of one term and owner, their rows and their documents; rows are sorted by term, owner, doc."""
    new = new_term | np.r_[True, owner[1:] != owner[:-1]]
    new_doc = new | np.r_[True, doc[1:] != doc[:-1]]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(new)]), np.add.reduceat(new_doc.astype(np.int64), first)


def count_terms(texts: list[bytes], owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(term, owner, n, docs) arrays: counts of each term of each owner, and the texts that have it.

    ``owners`` are numbers of the texts, ascending. Terms of up to 8 and 16 bytes are one and two words of 64
    bits, first byte on top; no term has a zero byte, so padding tells lengths. Longer terms are sorted as
    bytes, in buckets by powers of two of their length, so that padding at most doubles them.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), np.uint8)
    data = _LOWER[data]
    n = len(data) - 16
    letter = _LETTER[data[:n]]
    edge = np.flatnonzero(np.diff(np.r_[False, letter].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, side="right")
    length = stop - start
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))

    def packed(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        unused = (8 * (8 - np.clip(size, 1, 8))).astype(np.uint64)
        return (eight[at].astype(np.uint64) >> unused) << unused

    for n_words in (1, 2):
        rows = np.flatnonzero((length > 8 * (n_words - 1)) & (length <= 8 * n_words))
        if not len(rows):
            continue
        at, size = start[rows], length[rows]
        words = [packed(at + 8 * k, size - 8 * k) for k in range(n_words)]
        order = radix_order(words)
        words, d = [w[order] for w in words], doc[rows][order]
        new_term = np.r_[True, np.any([w[1:] != w[:-1] for w in words], axis=0)]
        first, count, docs = _run_counts(new_term, owners[d], d)
        term = np.stack([w[first] for w in words], axis=1).astype(">u8").view(f"S{8 * n_words}").ravel()
        yield term, owners[d][first], count, docs
    width = 32
    while (length > width // 2).any() if width > 32 else (length > 16).any():
        rows = np.flatnonzero((length > (width // 2 if width > 32 else 16)) & (length <= width))
        if len(rows):
            held = np.zeros(len(rows), f"S{width}")
            held[:] = [data[a:b].tobytes() for a, b in zip(start[rows].tolist(), stop[rows].tolist())]
            order = np.argsort(held, kind="stable")
            held, d = held[order], doc[rows][order]
            first, count, docs = _run_counts(np.r_[True, held[1:] != held[:-1]], owners[d], d)
            yield held[first], owners[d][first], count, docs
        width *= 2


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of some documents at a time; a group without a term has none."""

    def counted(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        rows["owner"] = rows.groupby(["lang", "source"]).ngroup()
        rows = rows.sort_values("owner", kind="stable")
        names = rows.drop_duplicates("owner")[["lang", "source"]]
        # Few owners are in a part, as rows are in their order.
        part = (rows["text"].str.len().cumsum() // TOGETHER).to_numpy()
        for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
            some = rows.iloc[at]
            for term, owner, n, docs in count_terms(some["text"].tolist(), some["owner"].to_numpy()):
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array(names["lang"].to_numpy()[owner], pa.string()),
                        "source": pa.array(names["source"].to_numpy()[owner], pa.string()),
                        "term": pa.array(term.tolist(), pa.binary()).cast(pa.string()),
                        "n": pa.array(n, pa.int64()),
                        "docs": pa.array(docs, pa.int64()),
                    }
                )

    held, size = [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "source": batch.column("source").to_pylist(), "text": texts})
        held.append(frame)
        size += sum(map(len, texts))
        if size >= HELD:
            yield from counted(pd.concat(held, ignore_index=True))
            held, size = [], 0
    if held:
        yield from counted(pd.concat(held, ignore_index=True))


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n, new: counts of the terms that ``least_docs`` documents of the language have.

    ``lang_n`` is the count in all of the language, ``new`` marks one row of each of its terms. The counts of
    the tasks are shuffled once, by language and term.
    """
    partial = docs.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # Both the sums and the windows below use this partitioning.
    summed = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    whole = summed.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("_docs"), F.sum("n").over(term).alias("lang_n"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("new"),
    )
    return cut_lineage(whole.where(F.col("_docs") >= least_docs).drop("_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact; 0 where there are no terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    below = (total + ADDED * terms).cast("decimal(20,0)")
    return F.when(below > 0, F.call_function("div", top, below) + 1).otherwise(F.lit(0)).cast("long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in integers of 64 bits, three digits a step; totals stay below 9 * 10**15."""
    high, rest = np.divmod(count + ADDED, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        high = high * 1000 + more
    return high + 1


def _pair_sums(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, other, value, covered) over the terms of a shard that a source of the two blocks has."""
    lang, _, left, right = key
    none = pd.DataFrame({"lang": [], "source": [], "other": [], "value": [], "covered": []}).astype(
        {"lang": str, "source": str, "other": str, "value": "int64", "covered": "int64"}
    )
    if not len(counts):
        return none
    sources = sources.sort_values("place", ignore_index=True)
    total = (sources["total"] + ADDED * sources["terms"]).to_numpy()
    column, terms = pd.factorize(counts["term"])
    row = np.searchsorted(sources["place"].to_numpy(), counts["place"].to_numpy())
    by_column = np.argsort(column, kind="stable")
    column, row, n = column[by_column], row[by_column], counts["n"].to_numpy()[by_column]
    block = sources["block"].to_numpy()
    own, other = np.flatnonzero(block == left), np.flatnonzero(block == right)
    value = np.zeros((len(own), len(other)), np.int64)
    wide = max(1, CELLS // len(sources))
    for low in range(0, len(terms), wide):
        a, b = np.searchsorted(column, [low, low + wide])
        matrix = np.zeros((len(sources), min(wide, len(terms) - low)), np.int64)
        matrix[row[a:b], column[a:b] - low] = n[a:b]
        matrix = shares(matrix, total[:, None])
        for k, i in enumerate(own):
            value[k] += np.abs(matrix[other] - matrix[i]).sum(axis=1)
    names = sources["source"].to_numpy()
    i, j = (x.ravel() for x in np.meshgrid(own, other, indexing="ij"))
    pairs = pd.DataFrame({"lang": lang, "source": names[i], "other": names[j], "value": value.ravel(), "covered": len(terms)})
    if left != right:
        turned = pairs.rename(columns={"source": "other", "other": "source"})
        pairs = pd.concat([pairs, turned[list(pairs)]])
    return pairs[pairs["source"] != pairs["other"]]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ in their terms.

    ``docs`` has text, lang and source, of which null is ''. Terms are runs of letters and characters outside
    ASCII, with A-Z lower-cased. Part pair: the sum over all kept terms of the distances of two sources' shares, for each
    other source of the language. Part term: kept terms that a source has more of than its language, the ``terms``
    first. Equal values rank by item. Groups without a kept term take part with counts of zero; a table without rows
    gives none.

    The distance over terms that neither of two sources has is the same for each of them, so only
    the counts above zero are shuffled: shards of terms for each two blocks of sources make small dense
    matrices. The rows out are all pairs of sources of a language, by definition.
    """
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    rows = docs.select(*text)
    kept = kept_counts(rows, least_docs)
    groups = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count_if("new").alias("terms"), F.count("*").alias("_rows"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    place = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")
    info = cut_lineage(
        groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", zero("total"), zero("terms"), zero("lang_total"), zero("_rows"), place.alias("place"))
        .withColumn("block", F.floor(F.col("place") / block))
        .withColumn("blocks", F.max("block").over(W.partitionBy("lang")) + 1)
        .withColumn("shards", F.ceil(F.col("_rows") / shard_rows))
    )

    def dealt(frame: DataFrame) -> DataFrame:
        """Rows once for each two blocks of which the own is one."""
        both = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda b: F.struct(F.least("block", b).alias("low"), F.greatest("block", b).alias("high")),
        )
        return frame.withColumn("_b", F.explode(both)).select("*", "_b.low", "_b.high").drop("_b")

    counts = kept.join(info.select("lang", "source", "place", "block", "blocks", "shards"), ["lang", "source"])
    counts = dealt(counts.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))).select("lang", "shard", "low", "high", "term", "place", "n")
    sides = info.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    # Fresh names for columns of ``info``, which both sides of the cogroup read.
    fresh = [F.col(c).alias(c) for c in ("lang", "shard", "low", "high", "source", "place", "block", "total", "terms")]
    sides = dealt(sides).select(*fresh)
    key = ["lang", "shard", "low", "high"]
    sums = (
        counts.groupBy(*key).cogroup(sides.groupBy(*key))
        .applyInPandas(_pair_sums, "lang string, source string, other string, value long, covered long")
        .groupBy("lang", "source", "other").agg(F.sum("value").alias("_value"), F.sum("covered").alias("_covered"))
    )
    one = info.select("lang", "source", "terms", share(F.lit(0), F.col("total"), F.col("terms")).alias("p"))
    others = info.select("lang", F.col("source").alias("other"), share(F.lit(0), F.col("total"), F.col("terms")).alias("q"))
    pairs = one.join(others, "lang").where("source != other").join(sums, ["lang", "source", "other"], "left")
    unseen = (F.col("terms") - F.coalesce("_covered", F.lit(0))) * F.abs(F.col("p") - F.col("q"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.coalesce("_value", F.lit(0)) + unseen).alias("value"))
    own = share(F.col("n"), F.col("total"), F.col("terms"))
    whole = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = kept.join(info, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (own - whole).alias("value"))
    # The limit also acts before the shuffle, so a task sends few terms of a group.
    part_term = more.where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= terms)
    return part_pair.withColumn("rank", F.row_number().over(by_value)).unionByName(part_term)


#: The same in SQL.
AUDIT_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
  k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
  z AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  p AS (SELECT lang, source, term, n,
      1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p,
      1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER w + 5 * count(*) OVER w) AS q
    FROM z WINDOW w AS (PARTITION BY lang, source)),
  f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(x.p - y.p)) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
  r AS (SELECT lang, source, part, item, CAST(coalesce(value, 0) AS BIGINT) AS value,
      CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item) AS INTEGER) AS rank FROM f)
  SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""
