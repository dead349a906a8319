"""SimHash near duplicates: Golay fuzzy hashing proposes pairs of fingerprints, which are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.components import min_components
from tidewire.llm.golay import WORD_BITS, near_codewords
from tidewire.llm.tokens import give_back
from tidewire.session import cut_lineage

#: Five blocks of the fingerprint: lowest bit and width. Four errors leave one block without error.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_BITS = 4


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of a text: words between ASCII white space, A-Z lowered, XXH64 (seed 42) of shingles.

    A bit is set if it is set in over half the shingle hashes. Fewer words than a shingle: the whole
    sequence is one; no word: zero.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = starts + sizes
        view = memoryview(joined)
        hashes = [
            xxh64_intdigest(view[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())
        ]
    counts, total = np.zeros(64, dtype=np.int64), len(hashes)
    packed = np.array(hashes, dtype="<u8")
    for at in range(0, total, 8192):  # bounded memory for very long texts
        counts += np.unpackbits(packed[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` with _fp, the fingerprint of text as a signed long (null text: empty)."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
        give_back()

    return docs.withColumn("_fp", prints(F.coalesce("text", F.lit(""))))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and the fingerprint of its text as a signed long (null text: empty)."""

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_fingerprint(rows, shingle).select("doc_id", F.col("_fp").alias("fp"))


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): keys such that two fingerprints within ``MAX_BITS`` errors have one in common.

    Four errors in five blocks leave a block without error, and of the other four blocks one of two
    halves has two errors at most. A key is the block's place and bits, the half, and the index of a
    codeword near the half's first 23 bits; near ones are shared at two errors (see golay.py). That
    makes about 53 keys of 25 bits per fingerprint.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                part = [((fp >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in BLOCKS]
                keys, owners = [], []
                for exact in range(len(BLOCKS)):
                    rest = [i for i in range(len(BLOCKS)) if i != exact]
                    for half in (0, 1):
                        i, j = rest[2 * half : 2 * half + 2]
                        word = (part[i] | part[j] << BLOCKS[i][1]) & ((1 << WORD_BITS) - 1)
                        near = near_codewords(word)
                        key = ((exact * 2 + half) << 40) | (part[exact] << 12)[:, None] | near
                        row, col = np.nonzero(near >= 0)
                        keys.append(key[row, col])
                        owners.append(fp[row])
                yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.concatenate(owners).view(np.int64)})
        give_back()

    return fps.select("fp").mapInPandas(run, "key long, fp long")


def near(a, b):
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """(fp, root): connected components of distinct fingerprints that link at ``MAX_BITS`` or fewer bits.

    Exact without listing the pairs of a dense group. First every fingerprint is compared with the
    smallest one of each of its buckets, and these links are merged. Then only buckets with more than
    one component are left; there, the fingerprints outside the bucket's commonest component are
    compared with all of the bucket that are in another component than theirs. Two fingerprints within
    the distance share a bucket, so they are in one component by then or compared in it.
    """
    spark = distinct.sparkSession
    keys = cut_lineage(fuzzy_keys(distinct))
    heads = keys.groupBy(F.col("key").alias("of")).agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    # A bucket of two is settled by the comparison with its head, so of these only links go on.
    to_head = (F.col("key") == F.col("of")) & ((F.col("n") > 2) | near(F.col("fp"), F.col("head")))
    shared = cut_lineage(keys.join(heads, to_head).select("key", "fp", "head", "n"))
    star = shared.where((F.col("fp") != F.col("head")) & near(F.col("fp"), F.col("head")))
    labels = min_components(star.select(F.col("head").alias("a"), F.col("fp").alias("b")))
    labelled = shared.where("n > 2").join(labels, F.col("fp") == F.col("node"), "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("label")
    )
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    left = cut_lineage(labelled.join(mixed, "key"))
    common = (
        left.groupBy("key", "label").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("common"))
    )
    outside = left.join(common, "key").where("label != common").select("key", "common", F.col("fp").alias("p"), F.col("label").alias("lp"))
    other = left.select(F.col("key").alias("k"), F.col("fp").alias("q"), F.col("label").alias("lq"))
    more = outside.join(
        other,
        (F.col("key") == F.col("k"))
        & (F.col("lp") != F.col("lq"))
        & ((F.col("lq") == F.col("common")) | (F.col("p") < F.col("q")))
        & near(F.col("p"), F.col("q")),
    ).select(F.col("lp").alias("a"), F.col("lq").alias("b"))
    over = min_components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    first = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return first.join(over, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicate_classes(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links of equal or near fingerprints reach).

    One row per row of ``docs``. Rows without doc_id get a component as well; a component that has
    no doc_id at all has a null component_id.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(link_fingerprints(distinct.select("fp")))
    names = distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(names, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_class(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """One row of each near-duplicate class, with the columns of ``docs``: the smallest doc_id, else by text hash.

    Of rows equal in doc_id and text one stays. ``docs`` is read twice, so it should be stored rows: its
    fingerprints are written without the texts; the classes are found on them, the chosen row of a
    class is a minimum over small columns, and only then the chosen rows' texts are joined.
    """
    key = ["_no_id", "_id", "_hash"]
    rows = docs.select(
        F.struct("*").alias("_doc"),
        "text",
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"),
        F.col("doc_id").isNull().alias("_no_id"),
        F.xxhash64("text").alias("_hash"),
    )
    marked = cut_lineage(with_fingerprint(rows.select("text", *key), shingle).drop("text"))
    roots = link_fingerprints(cut_lineage(marked.select(F.col("_fp").alias("fp")).distinct()))
    best = (
        marked.groupBy("_fp").agg(F.min(F.struct(*key)).alias("k"))
        .join(roots, F.col("_fp") == F.col("fp"))
        .groupBy("root").agg(F.min("k").alias("k"))
        .select("k.*")
    )
    return rows.drop("text").join(best, key).dropDuplicates(key).select("_doc.*")
