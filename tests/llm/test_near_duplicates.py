import random
import re

import xxhash
from itertools import combinations

from tidewire.llm.components import min_components
from tidewire.llm.golay import near_codewords
from tidewire.llm.simhash import fingerprint, fuzzy_keys, link_fingerprints, near_duplicate_classes

from .conftest import TEXTS


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_keys_meet_at_distance_two():
    rng = random.Random(5)
    words = [rng.getrandbits(23) for _ in range(300)]
    for w, keys in zip(words, near_codewords(words).tolist()):
        assert 1 <= sum(k >= 0 for k in keys) <= 6
        others = [w ^ (1 << i) ^ (1 << j) for i, j in [rng.sample(range(23), 2) for _ in range(20)]]
        others += [w ^ (1 << rng.randrange(23)), w]
        for other in near_codewords(others).tolist():
            assert set(k for k in keys if k >= 0) & set(other)


def test_fingerprints_of_odd_texts():
    for _, t in TEXTS:
        assert fingerprint(t or "") == plain_fingerprint(t)


def test_links_are_complete(spark):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(60)}
    # Chains and dense groups: many at the limit, some just over it.
    for centre in list(prints)[:12]:
        at = centre
        for _ in range(25):
            for bit in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])):
                at ^= 1 << bit
            prints.add(at)
            at = rng.choice([at, centre])
    prints |= {0, (1 << 64) - 1, 15, 31}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r["fp"]: r["root"] for r in link_fingerprints(frame).collect()}
    want = components(sorted(map(signed, prints)), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert got == want


def test_fuzzy_keys_are_about_fifty(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(200)], "fp long")
    assert 45 < fuzzy_keys(frame).count() / 200 < 60


def test_components_of_chains_and_loops(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000 + (i * 7) % 50) for i in range(50)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in min_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(n + 1)} == {0} and got[5000] == 5000 and got[1001] in got.values()
    assert min_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_whole_table(spark, docs, no_docs, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (real, docs):
        rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in frame.collect()]
        root = components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 4)
        least = {}
        for d, f in rows:
            if d is not None:
                least[root[f]] = min(least.get(root[f], d), d)
        want = sorted([(d, signed(f), least.get(root[f])) for d, f in rows], key=str)
        got = sorted([tuple(r) for r in near_duplicate_classes(frame).collect()], key=str)
        assert got == want
    assert near_duplicate_classes(no_docs).count() == 0
