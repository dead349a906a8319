import re
from collections import Counter, defaultdict

import numpy as np

from tidewire.llm.divergence import audit, count_terms, radix_order, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain_audit(rows, least_docs=30, top=50):
    have, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = terms(text)
        have[lang].update(set(own))
        count[lang, source].update(own)
    out = []
    for lang, source in groups:
        kept = {t for t, n in have[lang].items() if n >= least_docs}
        v = len(kept)
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: Counter({t: c for t, c in count[lang, s].items() if t in kept}) for s in sources}
        whole = sum(n.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)
        pairs = [(s, sum(abs(p(n[source], t) - p(n[s], t)) for t in kept)) for s in sources if s != source]
        more = [(t, p(n[source], t) - p(whole, t)) for t in kept if n[source][t]]
        for part, found, limit in (("pair", pairs, None), ("term", [x for x in more if x[1] > 0], top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:limit], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def odd_rows(docs):
    long = "Q" * 70 + "é" * 40
    return [
        (t.text, ["en", None, "", "de"][i % 4], ["a", "b", None, "é", "c"][i % 5]) for i, t in enumerate(docs.collect() * 3)
    ] + [(f"{long} {long}x word Word WORD abcdefgh abcdefghi {'k' * 16} {'k' * 17} {'k' * 5000}", "en", s) for s in "abcd"] + [("12 ., \x00", "xx", "s"), (None, "xx", "t")]


def test_against_counting(spark, docs, no_docs):
    rows = odd_rows(docs)
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    for least in (1, 2, 30):
        assert rows_of(audit(frame, least)) == plain_audit(rows, least)
    assert rows_of(audit(frame.selectExpr("*", "1 AS term", "2 AS place"), 2, terms=3, block=2, shard_rows=7)) == plain_audit(rows, 2, 3)
    assert audit(no_docs).count() == 0


def test_registered_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source")
    assert rows_of(audit(docs, block=3)) == plain_audit([tuple(r) for r in docs.collect()])


def test_counts_of_packed_terms():
    texts = ["ab AB Ab abc", "é abcdefgh abcdefghi abcdefghijklmnop", "", "ab " + "z" * 17 + " " + "Z" * 17 + " " + "y" * 33, "a" * 3000]
    owners = np.array([0, 0, 1, 2, 2])
    want = defaultdict(lambda: [0, 0])
    for text, owner in zip(texts, owners):
        for t, n in Counter(terms(text)).items():
            want[t.encode(), int(owner)][0] += n
            want[t.encode(), int(owner)][1] += 1
    got = {}
    for part in count_terms([t.encode() for t in texts], owners):
        for t, o, n, d in zip(*(x.tolist() for x in part)):
            assert (t, o) not in got
            got[t, o] = [n, d]
    assert got == dict(want)
    assert list(count_terms([b"", b"1 2"], np.array([0, 1]))) == []


def test_radix_order_is_stable():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 5, 500).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**63, 500).astype(np.uint64) % np.uint64(7)]
    assert radix_order(words).tolist() == sorted(range(500), key=lambda i: (int(words[0][i]), int(words[1][i])))


def test_shares_are_exact():
    count, total = np.array([0, 7, 10**14, 3]), np.array([5, 10**15 + 1, 10**15, 11])
    assert shares(count, total).tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(count.tolist(), total.tolist())]
