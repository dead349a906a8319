import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import expansion, resolve, vectors
from tidewire.sources import dims


def test_resolution_order(spark):
    names = [("Germany",), (" usa ",), ("Germny",), ("NATO",), ("Atlantis",), ("de",)]
    ents = spark.createDataFrame(names, "entity string")
    got = {r["entity"]: r["country"] for r in resolve.resolve_countries(ents, dims.aliases(spark)).collect()}
    assert got == {
        "Germany": "Germany", " usa ": "United States", "Germny": "Germany", "NATO": None, "Atlantis": None, "de": "Germany",
    }


def test_languages(spark):
    q = spark.createDataFrame([(1, ["China", "Kurdistan"]), (2, ["Nowhereland"])], "query_pos long, entities array<string>")
    got = resolve.languages_of_entities(
        q, "query_pos", dims.aliases(spark), dims.countries(spark), dims.regions(spark), dims.variants(spark)
    )
    assert {r["query_pos"]: r["languages"] for r in got.collect()} == {
        1: ["ar", "en", "ku", "zh", "zh-CN", "zh-HK", "zh-TW"], 2: ["en"],
    }


def test_combinations(spark):
    from datetime import datetime

    q = spark.createDataFrame(
        [(0, ["Iran", "Oil"], ["Iran"]), (1, ["Oil"], ["Iran"]), (2, ["None"], [])],
        "query_pos long, entities array<string>, countries array<string>",
    )
    got = expansion.entity_combinations(q, datetime(2024, 1, 31)).collect()
    assert sorted((r["query_pos"], r["keyword"], r["country"] or "") for r in got) == [
        (0, "Iran, Oil", ""), (0, "Iran, Oil", "Iran"), (0, "Oil  ", "Iran"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_history_equals_contains(spark, seed):
    rnd = random.Random(seed)
    words = ["ab", "abc", "oil", "war", "a", "über", "x-y"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    q = [(i, text(rnd.randint(1, 4))) for i in range(30)] + [(97, "-"), (98, "B"), (99, "")]
    now = datetime(2024, 1, 2)
    h = [(i, text(rnd.randint(1, 9)).upper(), now - timedelta(hours=rnd.choice([-1, 0, 3, 23, 24, 30]))) for i in range(60)]
    h.append((60, "oil war", None))
    got = resolve.query_history(
        spark.createDataFrame(q, "qid long, query string"), spark.createDataFrame(h, "hid long, query string, ts timestamp"), now
    )
    recent = [(j, b) for j, b, t in h if t and now - timedelta(hours=24) < t <= now]
    want = sorted((i, j) for i, a in q for j, b in recent if a and a.lower() in b.lower())
    assert sorted((r["qid"], r["hid"]) for r in got.collect()) == want


def test_contradiction_counts_equal_pairs(spark):
    rnd = random.Random(5)
    rows = [
        (e, p, rnd.choice(["true", "false", "uncertain"]), rnd.sample(range(6), 2), rnd.sample(range(6), 1))
        for e in range(20) for p in range(rnd.randint(1, 9))
    ]
    c = spark.createDataFrame(rows, "event_id long, claim_pos long, verdict string, supporting array<int>, contradicting array<int>")
    want = set()
    for e, i, v1, s1, _ in rows:
        for e2, j, v2, _, c2 in rows:
            if e == e2 and i < j and ({v1, v2} == {"true", "false"} or set(s1) & set(c2)):
                want.add((e, i, j))
    got = {tuple(r) for r in resolve.contradictions(c).collect()}
    assert got == want
    counts = {r["event_id"]: r["contradictions"] for r in resolve.contradiction_counts(c).collect()}
    for e in range(20):
        assert counts[e] == sum(w[0] == e for w in want)


def test_similarity_measures(spark):
    row = spark.sql("SELECT array(3.0D, 4.0D) AS a, array(3.0D, 4.0D) AS b, array(0.0D, 0.0D) AS z")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = row.select(vectors.cosine(a, b), vectors.euclidean(a, b), vectors.dot(a, b), vectors.cosine(a, z)).first()
    assert [round(x, 9) for x in got] == [1.0, 1.0, 25.0, 0.0]


def test_top_per_query_in_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    q, c = [(i, vec()) for i in range(7)], [(i, vec()) for i in range(90)]
    c += [(i + 90, v) for i, v in c] + [(999, None)]
    qd = spark.createDataFrame(q, "query_id long, embedding array<double>")
    cd = spark.createDataFrame(c, "id long, embedding array<double>")
    whole = sorted(tuple(r) for r in vectors.similar_per_query(qd, cd, 4).select("query_id", "id", "rank").collect())
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 100)
    cut = sorted(tuple(r) for r in vectors.similar_per_query(qd, cd, 4).select("query_id", "id", "rank").collect())
    assert whole == cut and len(whole) == 28

    def cos(x, y):
        d = sum(a * b for a, b in zip(x, y))
        return d / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)

    for i, v in q:
        best = sorted(c[:-1], key=lambda r: (-round(cos(v, r[1]), 12), r[0]))[:4]
        assert [b[0] for b in best] == [r[1] for r in sorted(whole, key=lambda r: (r[0], r[2])) if r[0] == i]


def test_near_per_query_recall(spark):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(32)] for _ in range(12)]
    c = [(i, [x + rnd.gauss(0, 0.55) for x in centres[i % 12]]) for i in range(600)] + [(600, None), (601, [0.0] * 32)]
    cd = spark.createDataFrame(c, "id long, embedding array<double>")
    qd = cd.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = vectors.similar_per_query(qd, cd, 1000, 0.7)
    want = {(r["query_id"], r["id"]): r["score"] for r in exact.collect()}
    near = vectors.near_per_query(qd, cd, 0.7, 1000)
    got = {(r["query_id"], r["id"]): r["confidence"] for r in near.collect()}
    assert got.keys() <= want.keys() and len(want) > 500
    assert len(got) >= 0.95 * len(want)
    assert all(abs(want[pair] - got[pair]) < 1e-9 for pair in got)
    assert vectors.near_per_query(qd.limit(0), cd, 0.7).count() == 0


def test_subscriptions_of_many_clauses(spark):
    from tidewire.operators import filters

    arts = spark.sql(
        "SELECT id, array('alpha') AS categories, concat('C', id % 3) AS country, array(concat('kw', id % 4)) AS keywords, "
        "'en' AS language, 0.5D AS relevance, 0.5D AS quality FROM range(40)"
    )
    subs = spark.sql(
        "SELECT id AS client, CAST(NULL AS array<string>) AS categories, array(concat('C', id % 3)) AS countries, "
        "array(concat('KW', id % 4)) AS keywords, 0.0D AS min_relevance, 0.2D AS min_quality, array('en') AS languages FROM range(11)"
    )
    found = sorted((r["id"], r["sub_client"]) for r in filters.route_to_subscribers(arts, subs).collect())
    assert found == sorted((a, c) for a in range(40) for c in range(11) if a % 3 == c % 3 and a % 4 == c % 4)


def test_combinations_of_eleven_entities(spark):
    from datetime import datetime

    from tidewire.operators.expansion import entity_combinations

    names = [f"e{i}" for i in range(11)]
    q = spark.createDataFrame([(1, names, ["France"])], "query_pos long, entities array<string>, countries array<string>")
    got = entity_combinations(q, datetime(2024, 1, 31))
    assert got.count() == 2**11 - 1 + 1 and got.where("country is null").first()["entities"] == names


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.75, 0.9, 1.0])
def test_similar_names_equal_all_pairs(spark, cutoff):
    rnd = random.Random(int(cutoff * 100))
    word = lambda: "".join(rnd.choice("aAbäc ") for _ in range(rnd.randint(1, 9)))
    texts = list({word() for _ in range(70)}) + ["", None, "aaaaaaaa" * 50]
    names = list({word() for _ in range(50)}) + ["", None]
    got = resolve.similar_names(
        spark.createDataFrame([(t,) for t in texts], "text string"),
        spark.createDataFrame([(n,) for n in names], "name string"), cutoff,
    )
    want = {
        (t, n): 1.0 - _distance(t.lower(), n.lower()) / max(len(t), len(n)) for t in texts if t for n in names if n
    }
    want = {k: pytest.approx(v) for k, v in want.items() if v >= cutoff}
    assert {(r["text"], r["name"]): r["similarity"] for r in got.collect()} == want


def test_names_beyond_a_small_dimension(spark):
    names = spark.range(5001).select(
        F.concat(F.lit("Land"), F.lpad(F.conv(F.col("id") * 7919, 10, 36), 5, "Q")).alias("country"), F.lit(0.0).alias("priority")
    ).withColumn("alias", F.lower("country"))
    some = [r["country"] for r in names.orderBy("country").limit(3).collect()]
    ents = spark.createDataFrame([(some[0],), (some[1][:4] + "#" + some[1][4:],), ("Elsewhere",)], "entity string")
    got = {r["entity"]: r["country"] for r in resolve.resolve_countries(ents, names).collect()}
    assert got[some[0]] == some[0] and got["Elsewhere"] is None
    near = got[some[1][:4] + "#" + some[1][4:]]
    assert near is not None and _distance(near.lower(), (some[1][:4] + "#" + some[1][4:]).lower()) <= 2


def test_only_distinct_entities_are_cut_into_grams(spark):
    """Spark must not move the test of the exploded grams below the distinct, to every row of the entities."""
    rows = spark.range(500).select(F.concat(F.lit("Franc"), (F.col("id") % 3).cast("string")).alias("entity"))
    aliases = spark.createDataFrame([("france", "France", 0)], "alias string, country string, priority int")
    got = resolve.resolve_countries(rows, aliases)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan
    assert sorted(map(tuple, got.collect())) == [(f"Franc{i}", "France") for i in range(3)]
    names = resolve.similar_names(rows.select(F.col("entity").alias("text")), aliases.select(F.col("country").alias("name")))
    assert "Range (" not in names._jdf.queryExecution().optimizedPlan().toString()


def test_near_per_query_shuffles_no_pairs(spark, monkeypatch):
    """Whatever meets under the signs, tasks pass on the best of each query; ties go by key over all blocks."""
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 64)
    rnd = random.Random(3)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, base[i % 5]) for i in range(60)]  # twelve copies of each vector
    cd = spark.createDataFrame(rows, "id long, embedding array<float>")
    qd = spark.createDataFrame([(i, base[i]) for i in range(5)], "query_id long, embedding array<float>")
    got = vectors.near_per_query(qd, cd, 0.9, 3, bits=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "Aggregate" not in plan
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == [(i, i + 5 * j, j + 1) for i in range(5) for j in range(3)]


def test_query_history_without_hours(spark):
    """Without ``hours`` all of the history counts, also what has no time."""
    h = spark.createDataFrame([(1, "a big oil deal", datetime(2020, 1, 1)), (2, "no Oil", None), (3, "gas", datetime(2024, 1, 1))], "hid long, query string, ts timestamp")
    q = spark.createDataFrame([(7, "oil"), (8, "gas"), (9, "")], "qid long, query string")
    got = resolve.query_history(q, h, datetime(2024, 1, 1), hours=None)
    assert sorted(map(tuple, got.collect())) == [(7, 1), (7, 2), (8, 3)]
    assert sorted(map(tuple, resolve.query_history(q, h, datetime(2024, 1, 1)).collect())) == [(8, 3)]


def test_query_history_has_no_join(spark, monkeypatch):
    """Texts meet the queries in place, whatever the number of portions the queries are sent in; equal queries keep all their askers."""
    rnd = random.Random(4)
    words = ["ab", "oil", "embargo", "über", "x", "agreement"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    q = [(i % 40, text(rnd.randint(1, 4))) for i in range(50)] + [(41, "go ag"), (42, "ü"), (43, None), (None, "oil")]
    h = [(i % 30, text(rnd.randint(1, 12)).upper()) for i in range(40)] + [(50, None), (None, "oil")]
    monkeypatch.setattr(resolve, "SENT", 500)
    got = resolve.query_history(spark.createDataFrame(q, "qid long, query string"), spark.createDataFrame(h, "hid long, query string"), hours=None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") > 1
    want = sorted((i, j) for i, a in q for j, b in h if None not in (i, j, a, b) and a.lower() in b.lower())
    assert sorted(map(tuple, got.collect())) == want
