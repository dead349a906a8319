import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewire.llm.queries import op12_periodic_runs, with_planted_runs
from tidewire.llm.runs import find_runs, word_runs


def plain_runs(words, least=12):
    """Stretches of words equal a period apart, for every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k < len(words) - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < len(words) - q and words[k] == words[k + q]:
                k += 1
            if k - start + q >= max(least, 2 * q):
                found.setdefault((start, k - start + q), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return (text or "").encode().split()


def collapsed(words, runs):
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_arrays_against_every_period(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k, p = rng.randint(0, 70), rng.choice([1, 2, 3, 9]), rng.randint(1, 12)
            base = [rng.randrange(k) for _ in range(p)]
            texts.append(rng.choice([fibonacci(n), [rng.randrange(k) for _ in range(n)], [base[i % p] for i in range(n)] + [rng.randrange(k) for _ in range(9)]]))
        words = np.array([w for t in texts for w in t], np.int64)
        if not len(words):
            continue
        docs = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        want, at = [], 0
        for t in texts:
            want += [(s + at, m, q) for s, m, q in plain_runs(t, least)]
            at += len(t)
        assert list(zip(*(x.tolist() for x in word_runs(words, docs, least)))) == want


def test_long_runs_take_few_steps():
    for words in (np.zeros(60_000, np.int64), np.arange(60_000) % 7000):
        start, length, period = word_runs(words, np.zeros(len(words), np.int64))
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [60_000], [7000 if words[1] else 1])


def test_rows_keep_their_columns(spark, docs, no_docs):
    texts = [(1, "a b " * 9 + "c", "r"), (2, None, "r"), (3, "", "r"), (4, "é  x\n" * 12, "r"), (4, "é  x\n" * 12, "r"), (5, "x " * 4000, "r"), (None, "y " * 13, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, runs string").repartition(2)
    got = find_runs(frame)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    for r in [*got.collect(), *find_runs(docs).collect()]:
        runs = plain_runs(split(r.text)) if len(split(r.text)) < 4000 else [(0, 4000, 1)]
        assert [(x.start, x.length, x.period) for x in r.runs] == runs
        assert r.collapsed.encode() == collapsed(split(r.text), runs)
    assert find_runs(docs).count() == docs.count() and find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs.drop("text"))


def plain_query(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(collapsed(words, runs))


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, sf).collect())
    want = sorted(plain_query(r.doc_id, r.text) for r in docs if len(split(r.text)) < 1500)
    ids = {w[0] for w in want}
    assert [g for g in got if g[0] in ids] == want and len(got) == len(docs)
    assert sum(g[1] > 0 for g in got) >= len(docs) // 20


def test_planting_of_odd_rows(spark, docs):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts = [None, "", " \n", "one", "one two", "w0 w1 w2 w3  w4\nw5 w6 w7 w8"]
    frame = spark.createDataFrame(list(zip(ids, texts)) + [(None, "a b")], "doc_id long, text string")
    for r in with_planted_runs(frame).collect():
        words = split(dict([*zip(ids, texts), (None, "a b")])[r.doc_id])
        assert len(split(r.text)) == len(words)
        if r.doc_id is None or not words:
            assert split(r.text) == words
