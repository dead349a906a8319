import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tidewire.llm.mixing import mix, mixed_texts, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Deal the words out, take back what is over, deal that to the others, until nothing is over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, live = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while live and rest > 1e-9:
        total = sum(weight[s] for s in live)
        for s in live:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - epochs * sizes[s]) for s in live)
        live = {s for s in live if target[s] < epochs * sizes[s]}
        target = {s: min(t, epochs * sizes[s]) for s, t in target.items()}
    return target


def plain_taken(rows, target):
    by_source = defaultdict(list)
    for doc_id, source, text in rows:
        key = hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        by_source[source].append((key, doc_id, len(WORD.findall(text or ""))))
    out = []
    for source, docs in by_source.items():
        size, left = sum(d[2] for d in docs), int(target[source])
        taken = Counter()
        for _ in range(3):
            for place, d in enumerate(sorted(docs, key=lambda d: (d[0], str(d[1])))):
                n = min(left, d[2])
                taken[place] += n
                left -= n
        out += [(d[1], source, d[2], size, taken[p]) for p, d in enumerate(sorted(docs, key=lambda d: (d[0], str(d[1]))))]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)


def compare(spark, rows, **how):
    got = mix(frame(spark, rows), **how).collect()
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
    exact = {r.source: r.target for r in got}
    want = plain_taken(rows, exact)
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got), key=str) == sorted(want, key=str)
    assert all(r.taken <= 2 * r.size for r in got)
    return got


def odd_rows(docs):
    return [(r.doc_id, ["a", "Z", None, "", "é"][i % 5], r.text) for i, r in enumerate(docs.collect())]


def test_mix_of_odd_rows(spark, docs, no_docs):
    rows = odd_rows(docs)
    compare(spark, rows)
    compare(spark, rows, range_rows=1)
    assert mix(no_docs).count() == 0 and mixed_texts(no_docs).count() == 0


def test_small_sources_are_full_and_the_rest_goes_on(spark):
    rows = [(i, "big", "w " * 40) for i in range(50)] + [(100 + i, "small", "a b c") for i in range(4)] + [(200, None, None), (201, "none", "")]
    got = compare(spark, rows, range_rows=7)
    by = {r.source: r.target for r in got}
    assert by["small"] == 24 and by[None] == by["none"] == 0 and by["big"] == 1.5 * 2012 - 24


def test_repeated_rows_take_turns(spark):
    rows = [(7, "s", "one two three")] * 5 + [(8, "s", "x y")] + [(9, "t", "p q r s")] * 3 + [(None, "t", "k")] * 2
    compare(spark, rows)


def test_texts_of_the_mix(spark, docs):
    rows = odd_rows(docs)
    whole = frame(spark, rows).selectExpr("*", "1 AS epoch", "'x' AS extra")
    taken = Counter()
    for r in mix(frame(spark, rows)).collect():
        taken[(r.doc_id, r.source)] += r.taken
    texts = mixed_texts(whole)
    assert texts.columns == ["doc_id", "source", "text", "extra", "epoch", "n_words"]
    out, own = Counter(), defaultdict(set)
    for doc_id, source, text in rows:
        own[doc_id, source].add(text)
    for r in texts.collect():
        out[(r.doc_id, r.source)] += r.n_words
        assert len(WORD.findall(r.text)) == r.n_words and r.epoch in (0, 1)
        assert r.text in own[r.doc_id, r.source] or any(t and " ".join(WORD.findall(t)).startswith(r.text) for t in own[r.doc_id, r.source])
    assert out == +taken


def test_reruns_agree_and_targets_of_other_weights(spark, docs):
    rows = odd_rows(docs)
    one, two = ({(r.doc_id, r.size, r.taken) for r in mix(frame(spark, rows), seed="s").collect()} for _ in range(2))
    assert one == two
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes, weights=(1, 1), share=0.3, epochs=1).collect()}
    want = plain_targets({"a": 10, "b": 1000, "c": 100}, weights=(1, 1), share=0.3, epochs=1)
    assert got == pytest.approx(want)
