import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import char_ngrams as cn, ngram_quality as nq


def codes(text):
    return [-1] * (cn.ORDER - 1) + [ord(c) for c in text] + [-2]


def grams(text):
    w = codes(text)
    return [tuple(w[i : i + cn.ORDER]) for i in range(len(w) - cn.ORDER + 1)]


def plain_model(texts):
    """Interpolated modified Kneser-Ney of characters by dictionaries."""
    counts = Counter(g for t in texts for g in grams(t))
    levels = []
    for _ in range(cn.ORDER):
        n = [max(sum(v == k for v in counts.values()), 0.5) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(1 - 2 * y * n[1] / n[0], 0.1), 0.9), min(max(2 - 3 * y * n[2] / n[1], 0.1), 1.8), min(max(3 - 4 * y * n[3] / n[2], 0.1), 2.7)]
        total, lost = Counter(), Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            lost[g[:-1]] += d[min(v, 3) - 1]
        levels.insert(0, (counts, d, total, lost))
        counts = Counter(g[1:] for g in counts)

    def p(g):
        if not g:
            return 1 / (len(levels[0][0]) + 1)
        c, d, total, lost = levels[len(g) - 1]
        if not total[g[:-1]]:
            return p(g[1:])
        own = (c[g] - d[min(c[g], 3) - 1]) / total[g[:-1]] if g in c else 0
        return own + lost[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


TRAIN = ["the cat sat on the mat. The dog, too!\nthe end", "un été à la mer; 12 cats", "the the the cat", "我们 今天去看海。", "the cat sat here 😀"]
ASKED = [*TRAIN, "the cat sat on a mat", "tam a no tas tac eht", "Ωmega", "海看去天今们我", "我们去看海", " \n", "!!", "a"]


def frame(spark, texts):
    return spark.createDataFrame([(t, 7) for t in texts], "text string, gain int").repartition(2)


@pytest.mark.parametrize("head", [cn.HEAD, 40, 1])
def test_characters_follow_kneser_ney(spark, head):
    """Also where most of the table is beyond the head and joined by key."""
    model = cn.train(frame(spark, TRAIN), head)
    assert (model.entries > head) == (head < cn.HEAD)
    p = plain_model(TRAIN)
    found = cn.with_surprise(frame(spark, [*ASKED, ASKED[0], "", None]), model)
    assert found.columns == ["text", "gain", "surprise"]
    rows = found.collect()
    assert len(rows) == len(ASKED) + 3 and all((r.surprise is None) == (not r.text) for r in rows)
    got = {r.text: r.surprise for r in rows}
    for text in ASKED:
        want = -sum(math.log(p(g)) for g in grams(text)) / len(grams(text))
        assert abs(got[text] - want) < 1e-9, text
    assert got["the cat sat on a mat"] < got["tam a no tas tac eht"] and got["我们去看海"] < got["海看去天今们我"]


def test_long_texts_and_many_characters_are_scored_whole(spark, monkeypatch):
    text = "abc def " * 400 + "".join(chr(0x4E00 + i) for i in range(9000)) + "abc"
    p = plain_model([text])
    want = -sum(math.log(p(g)) for g in grams(text)) / len(grams(text))
    model = cn.train(frame(spark, [text]))
    assert abs(cn.with_surprise(frame(spark, [text]), model).first().surprise - want) < 1e-9
    lookup = cn.lookup_of(model.gains)
    monkeypatch.setattr(cn, "CHUNK", 500)
    cut, _ = cn.score_texts(["abc", text, "x"], lookup, False)
    whole = -(model.unseen + (cut[1] + model.begin) / (len(text) + 1))
    assert abs(whole - want) < 1e-9


def test_the_table_grows_with_the_text(spark):
    size = [cn.train(frame(spark, [f"{chr(0x4E00 + 3 * i)}{chr(0x4E00 + i)} x" for i in range(n)])).entries for n in (20, 200)]
    assert size[1] > 5 * size[0]
    assert cn.train(frame(spark, TRAIN).where("1 = 0")).entries == 0


def test_limits_come_from_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in nq.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    asked = labels.where("doc_id % 2 = 1").collect()
    bad = [got[r.doc_id].kept for r in asked if r.quality == 0]
    good = [got[r.doc_id].kept for r in asked if r.quality == 1]
    print("kept good", sum(good), len(good), "kept bad", sum(bad), len(bad))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_limits_of_languages_with_many_and_few(spark):
    rows = [("a", float(i)) for i in range(1, 1001)] + [("b", 2000.0), ("b", 2001.0), ("b", 2002.0), (None, 1.0)]
    limits, whole = nq.limits_of(spark.createDataFrame(rows, "lang string, surprise double"))
    got = {r._of: r._limit for r in limits.collect()}
    # Of 1003 distances from the own median the quantile is that of language a: no fixed margin.
    assert got["a"] == 990 and abs(got["b"] - (2001 + 490)) <= 5 and whole >= 990


def test_filter_keeps_every_id(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(-50, 50), 2**40, -(2**62)]], "doc_id long")
    docs = spark.createDataFrame([(i, "t") for i in [*range(-500, 500), 2**40, -(2**62), None]], "doc_id long, text string")
    kept = {r.doc_id for r in nq.in_filter(docs, ids).collect()}
    assert {r.doc_id for r in ids.collect()} <= kept and len(kept) <= 110 and None not in kept
    assert nq.in_filter(docs, ids.where("1 = 0")).count() == 0


def test_scoring_holds_few_arrays_of_a_piece_at_once():
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(97, 123, cn.CHUNK - 100)))
    lookup = cn.Lookup(rng.integers(0, 2**63, 1000).astype(np.uint64), rng.random(1000))
    tracemalloc.start()
    try:
        cn.score_texts([text], lookup, False)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Of eight bytes for each character.
    assert most < 18 * 8 * cn.CHUNK


def test_gains_of_a_block_at_a_time_are_those_of_all(monkeypatch):
    texts = ["to be or not to be", "", "that is the question " * 20, "\U0001f600 caf\u00e9"]
    found = [g for _, hi, lo, _ in cn._grams(texts[:3]) for g in zip(hi.tolist(), lo.tolist())]
    hi, lo = np.array(found, np.int64).T
    lookup = cn.Lookup(cn._hash(hi, lo), np.arange(len(hi), dtype=float) / 7)
    whole = cn.score_texts(texts, lookup, True)
    monkeypatch.setattr(cn, "BLOCK", 5)
    parts = cn.score_texts(texts, lookup, True)
    assert whole[0].tolist() == parts[0].tolist() and whole[1] == parts[1] and whole[0][0] > 0 and whole[1][3]
