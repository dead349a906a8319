import hashlib
from pyspark.sql import functions as F

from tidewire.llm.fingerprints import UNITS, fingerprints_with_edits, likeness, order_minhash, with_next

from .conftest import TEXTS


def units(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.u for r in frame.select("i", order_minhash(F.col("t")).alias("u")).orderBy("i").collect()]


def test_likeness_follows_edits_and_order(spark):
    words = [f"word{i}" for i in range(400)]
    base = " ".join(words)
    one = " ".join([*words[:200], "other", *words[201:]])
    half = " ".join([*words[:200], *(f"new{i}" for i in range(200))])
    moved = " ".join([*words[200:], *words[:200]])
    got = units(spark, [base, base, one, half, moved, "", None and "", "  \n", "just two", "x " * 5000, "x " * 5001, "a b c"])
    like = lambda i, j: sum(a == b for a, b in zip(got[i], got[j])) / UNITS
    assert like(0, 1) == 1 and 0.8 < like(0, 2) < 1 and 0.02 < like(0, 3) < 0.5
    # Moving half of the text keeps its set of k-mers and still shows.
    assert like(0, 4) < 0.9
    assert got[5] == [None] * UNITS == got[7] and like(9, 10) > 0.9 and like(8, 11) == 0


def plain_edits(rows):
    """Edited texts by position in descending doc_id; equal ids and null ids are not compared."""
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def test_edits_of_the_next_document(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = sorted([(r.doc_id, r.text or "") for r in table.collect()], reverse=True)
    want = plain_edits(rows)
    got = fingerprints_with_edits(table).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    following = {i: rows[(k + 1) % len(rows)][0] for k, (i, _) in enumerate(rows)}
    prints = {r.doc_id: r.fingerprint for r in got}
    share = lambda a, b: sum(a[i : i + 16] == b[i : i + 16] for i in range(0, 16 * UNITS, 16)) / UNITS
    for r in got:
        assert r.near_next == share(r.fingerprint, prints[following[r.doc_id]])
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint)


def test_odd_rows(spark, docs, no_docs):
    got = fingerprints_with_edits(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in TEXTS)
    first = next(r for r in got if r.doc_id == 2**40)
    assert first.near_next < 1
    last = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"])
    assert sorted(r.next_text for r in last.collect()) == sorted(t or "" for _, t in TEXTS)
    alone = fingerprints_with_edits(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert fingerprints_with_edits(no_docs).count() == 0
    assert spark.range(1).select(likeness(F.array(F.lit(1), F.lit(None)), F.array(F.lit(1), F.lit(None))).alias("x")).first().x == 2 / UNITS
