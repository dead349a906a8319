import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedup


def fold(rows):
    """Plain ordered merge of one run: (pos, entities, valid)."""
    clusters, seen, out = [], set(), {}
    for pos, ents, valid in rows:
        home = next((c for c in clusters if c[1] & set(ents)), None)
        if home:
            home[1].update(ents)
            out[pos] = home[0]
            continue
        combo = tuple(sorted(e.lower().strip() for e in ents))
        if valid and ents and combo not in seen:
            seen.add(combo)
            clusters.append((pos, set(ents)))
            out[pos] = pos
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(r, p, "t" if v else "", "d", e, e if v else []) for r, p, e, v in rows],
        "run_id long, pos long, title string, description string, entities array<string>, geo_entities array<string>",
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cluster_equals_fold(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "f", "g", "A", " b"]
    rows = []
    for run in range(12):
        for p in range(rnd.randint(1, 12)):
            ents = rnd.sample(names, rnd.randint(0, 3))
            rows.append((run, p, ents, rnd.random() < 0.7))
    got = {(r["run_id"], r["pos"]): r["cluster"] for r in dedup.cluster_flashpoints(frame(spark, rows)).collect()}
    want = {}
    for run in range(12):
        for p, c in fold([(p, e, v) for r, p, e, v in rows if r == run]).items():
            want[(run, p)] = c
    assert got == want


def test_third_row_joins_first_cluster_only(spark):
    rows = [(1, 0, ["a", "b"], True), (1, 1, ["c"], True), (1, 2, ["b", "c"], True)]
    got = {r["pos"]: r for r in dedup.merge_flashpoints(frame(spark, rows)).collect()}
    assert got[0]["entities"] == ["a", "b", "c"] and got[0]["members"] == 2 and got[0]["title"] == "t / t"
    assert got[1]["entities"] == ["c"]


def test_long_chain_settles_in_few_rounds(spark):
    rows = [(1, i, [f"e{i}", f"e{i + 1}"], True) for i in range(150)]
    got = dedup.cluster_flashpoints(frame(spark, rows)).groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [(0, 150)]


def test_repeated_combination_is_rejected(spark):
    rows = [(1, 0, ["a"], True), (1, 1, ["A"], True), (1, 2, ["A", "z"], True)]
    got = {r["pos"]: r["cluster"] for r in dedup.cluster_flashpoints(frame(spark, rows)).collect()}
    assert got == {0: 0, 2: 2}


def test_components_are_transitive(spark):
    rows = [(1, i, [f"e{i}", f"e{i + 1}"], True) for i in range(40)] + [(1, 99, ["x"], True)]
    got = dedup.entity_components(frame(spark, rows)).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, 40), (99, 1)]


def test_merge_feeds_prefers_article_lists(spark):
    s = "flashpoint_id long, query_pos long, pos long, url string"
    a = spark.createDataFrame([(1, 0, 0, "u1"), (1, 0, 1, "u2")], s)
    b = spark.createDataFrame([(1, 0, 0, "u2"), (1, 0, 1, "u3")], s)
    got = {r["url"]: r["src_rank"] for r in dedup.merge_feeds(a, b).collect()}
    assert got == {"u1": 0, "u2": 0, "u3": 1}


def test_hot_url_is_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"))
    plan = dedup.first_per_url(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    assert dedup.first_per_url(df).where("url = 'hot'").first()["pos"] == 0


def test_top_k_limits_before_the_shuffle(spark):
    from tidewire.operators.scans import top_k

    df = spark.range(20000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], 5000, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("width", [2, 50, 5000])
def test_position_equals_row_number(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice("aab"), rnd.randrange(100), i) for i in range(200)]
    from tidewire.operators.scans import position

    got = position(spark.createDataFrame(rows, "k string, o long, t long"), ["k"], "o", "t", width=width).collect()
    for r in got:
        assert r["position"] == 1 + sum(k == r["k"] and (o, t) < (r["o"], r["t"]) for k, o, t in rows)


def test_rounds_write_only_what_fell(spark, monkeypatch):
    written = []

    def seen(df):
        out = cut(df)
        if {"component", "cluster"} & set(out.columns):
            written.append(out.count())
        return out

    cut = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", seen)
    # One entity names most rows, and a chain of a few takes more rounds.
    rows = [(1, i, ["hot"], True) for i in range(200)] + [(1, 200 + i, [f"e{i}", f"e{i + 1}"], True) for i in range(40)]
    for operator, want in ((dedup.entity_components, {0: 200, 200: 40}), (dedup.cluster_flashpoints, {0: 200, 200: 40})):
        written.clear()
        got = operator(frame(spark, rows))
        label = got.columns[-1]
        assert {r[label]: r["count"] for r in got.groupBy(label).count().collect()} == want
        # The start, the rounds, nothing in the last one, and the result.
        start, *rounds, result = written
        assert (start, result) == (240, 240) and rounds[-1] == 0 and len(rounds) <= 9
        assert rounds == sorted(rounds, reverse=True) and rounds[1] < 40


def test_clusters_read_their_rows_once(spark, monkeypatch):
    reads, written = [], dedup.cut_lineage

    def seen(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        return written(df)

    monkeypatch.setattr(dedup, "cut_lineage", seen)
    rows = frame(spark, [(1, 0, ["a", "b", "a"], True), (1, 1, ["b"], True), (1, 2, ["c"], False), (2, 0, None, False)])
    got = dedup.cluster_flashpoints(rows).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 1, 0)]
    assert sum(reads) == 1


def test_a_column_stands_for_the_texts(spark):
    rows = frame(spark, [(1, 0, ["a"], True), (1, 1, ["b"], False), (1, 2, ["a", "b"], True), (1, 3, ["c"], True)])
    empty = rows.withColumn("description", F.when(F.col("pos") != 3, F.col("description")))
    lean = empty.select("run_id", "pos", "entities", "geo_entities", dedup.has_texts().alias("has_texts"))
    want = [(1, 0, 0), (1, 2, 0)]
    assert sorted(map(tuple, dedup.cluster_flashpoints(lean).collect())) == want
    assert sorted(map(tuple, dedup.cluster_flashpoints(empty).collect())) == want


@pytest.mark.parametrize("name", ["dd07_cluster_flashpoints", "dd07_merge_flashpoints"])
def test_entities_are_taken_from_whole_texts_once(spark, monkeypatch, tmp_path, name):
    from tidewire.catalog import QUERIES, dedups

    texts = ["tide river alpha", "tide stone", "river stone", "", None, "market harbour", "harbour NATION tide", "market x"]
    docs = [(i, None if t is None else f"{t}\nbody {t}", "en", "s", 0) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    nations = [(i, f"NATION_{i}", 0) for i in range(25)]
    spark.createDataFrame(nations, "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    plans, written = [], dedup.cut_lineage

    def seen(df):
        plans.append(df)
        return written(df)

    monkeypatch.setattr(dedup, "cut_lineage", seen)
    monkeypatch.setattr(dedups, "cut_lineage", seen, raising=False)
    got = QUERIES[name](spark, str(tmp_path))
    words = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") for df in [*plans, got]]
    assert got.count() > 0 and sum(words) == 1


def test_components_equal_plain_search(spark):
    rnd = random.Random(5)
    rows = [(r, p, rnd.sample([f"n{i}" for i in range(14)], rnd.randint(0, 2)), True) for r in range(9) for p in range(rnd.randint(1, 14))]
    want = {}
    for run in range(9):
        mine = {p: set(e) for r, p, e, _ in rows if r == run}
        label = {p: p for p in mine}
        for _ in mine:
            for p in mine:
                label[p] = min([label[p], *(label[q] for q in mine if mine[p] & mine[q])])
        want |= {(run, p): c for p, c in label.items()}
    got = {(r["run_id"], r["pos"]): r["component"] for r in dedup.entity_components(frame(spark, rows)).collect()}
    assert got == want
