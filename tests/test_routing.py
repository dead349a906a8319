"""Subscription matching against a plain loop over all pairs."""

import random

from pyspark.sql import functions as F

from tidewire.operators import filters as fl
from tidewire.streaming import flows

ARTICLE = "id long, categories array<string>, country string, keywords array<string>, relevance double, quality double, language string"
SUBSCRIPTION = (
    "client long, categories array<string>, countries array<string>, keywords array<string>, "
    "min_relevance double, min_quality double, languages array<string>, note string"
)


def plain(a, s):
    text = " ".join(a[3]).lower()
    return (
        (not s[1] or bool(set(s[1]) & set(a[1])))
        and (not s[2] or any(c in a[2] for c in s[2]))
        and (not s[3] or any(k.lower() in text for k in s[3]))
        and (not s[4] or a[4] >= s[4])
        and (not s[5] or a[5] >= s[5])
        and (not s[6] or a[6] in s[6])
    )


def some(rnd, values, most):
    return rnd.choice([None, [], rnd.choices(values, k=rnd.randint(1, most))])


def test_pairs_equal_a_loop(spark):
    rnd = random.Random(11)
    words = ["oil", "warfare", "a b", "energy", "gas", "élan", "x"]
    articles = [
        (i, rnd.sample(["p", "q", "r"], rnd.randint(0, 3)), rnd.choice(["NATION_1", "NATION_12", "UK", ""]), rnd.choices(words, k=rnd.randint(0, 4)),
         rnd.random(), rnd.random(), rnd.choice(["en", "fr", "de"]))
        for i in range(80)
    ]
    subs = [
        (i, some(rnd, ["p", "q", "z"], 3), some(rnd, ["NATION_1", "K", "ION", "XX"], 2), some(rnd, ["OIL", "war", "fare en", "b gas", "x", "lan", "oi", "none"], 3),
         rnd.choice([0.0, None, 0.4]), rnd.choice([0.0, 0.3]), some(rnd, ["en", "fr"], 2), f"n{i}")
        for i in range(60)
    ]
    subs += [(100 + i, None, None, [""], 0.0, None, None, "all") for i in range(20)]  # a hot filter, matched once
    got = fl.route_to_subscribers(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(subs, SUBSCRIPTION))
    assert got.columns == [*[c.split()[0] for c in ARTICLE.split(", ")], *["sub_" + c.split()[0] for c in SUBSCRIPTION.split(", ")]]
    rows = got.collect()
    assert sorted((r["id"], r["sub_client"]) for r in rows) == sorted((a[0], s[0]) for a in articles for s in subs if plain(a, s))
    assert all(r["sub_note"] == ("all" if r["sub_client"] >= 100 else f"n{r['sub_client']}") for r in rows)


def test_index_has_one_clause_per_filter(spark):
    subs = spark.range(1000).select(
        F.col("id").alias("client"), F.array(F.lit("p")).alias("categories"), F.array((F.col("id") % 3).cast("string")).alias("countries"),
        F.array(F.lit("tion"), F.lit("SCH")).alias("keywords"), F.lit(0.0).alias("min_relevance"), F.lit(0.0).alias("min_quality"),
        F.lit(None).cast("array<string>").alias("languages"),
    )
    index = fl.predicate_index(fl._profiles(subs)).collect()
    assert sorted(r["_key"] for r in index) == ["n:0", "n:1", "n:2"]


def test_matches_are_not_shuffled(spark, monkeypatch):
    """A filter of many clients: portions of clients come with the index, and no join follows the check of the filter."""
    monkeypatch.setattr(fl, "CLIENTS", 7)
    subs = spark.createDataFrame([(i % 90, None, None, ["OIL"], None, None, None, f"n{i}") for i in range(100)], SUBSCRIPTION)
    portions = fl._clients(fl._profiles(subs)).collect()
    assert sum(len(r["_clients"]) for r in portions) == 100 and len(portions) > 5
    articles = spark.createDataFrame([(i, [], "", ["oil" if i % 2 else "gas"], 0.5, 0.5, "en") for i in range(6)], ARTICLE)
    got = fl.route_to_subscribers(articles, subs).select("id", "sub_client", "sub_note")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan
    assert sorted(map(tuple, got.collect())) == sorted((a, i % 90, f"n{i}") for a in (1, 3, 5) for i in range(100))


def _two_tables(spark):
    rnd = random.Random(3)
    articles = [
        (i, rnd.sample(["p", "q"], rnd.randint(0, 2)), rnd.choice(["NATION_1", "NATION_12", "NATION_2"]), rnd.choices(["warfare", "gas", "x"], k=2),
         rnd.random(), rnd.random(), rnd.choice(["en", "fr", None]))
        for i in range(40)
    ]
    subs = [
        (i % 50, [None, ["p"]][i % 2], [None, [f"NATION_{i % 3}"]][i // 2 % 2], [[], ["WARF", "as"]][i // 4 % 2], 0.0, [0.0, 0.4][i // 8 % 2], [None, ["en"]][i // 16 % 2], f"n{i}")
        for i in range(64)
    ]
    want = sorted((a[0], s[0], s[7]) for a in articles for s in subs if plain(a, s))
    return spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(subs, SUBSCRIPTION), want


def test_articles_are_not_shuffled(spark):
    """Whatever Spark's own threshold is, an index of measured small size goes to all tasks."""
    articles, subs, want = _two_tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fl.route_to_subscribers(articles, subs).select("id", "sub_client", "sub_note")
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got.collect())) == want


def test_large_index_is_joined_by_key(spark, monkeypatch):
    """Pieces that no filter stands under are dropped before the join."""
    articles, subs, want = _two_tables(spark)
    monkeypatch.setattr(fl, "SHARED", 0)
    got = fl.route_to_subscribers(articles, subs).select("id", "sub_client", "sub_note")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    assert sorted(map(tuple, got.collect())) == want
    routes = fl.Routes(subs)
    assert sorted(map(tuple, routes.clients_of(routes.matches(articles)).select("id", "sub_client", "sub_note").collect())) == want


def test_a_kept_sink_has_matches_not_pairs(spark, tmp_path):
    """A stream writes an article once per filter, however many clients the filter has."""
    articles, subs, want = _two_tables(spark)
    articles.write.parquet(f"{tmp_path}/in")
    many = subs.withColumn("sub", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("sub")
    routes = fl.Routes(many)
    stream = spark.readStream.schema(articles.schema).parquet(f"{tmp_path}/in")
    flows.run_available(flows.routed_updates(stream, routes).select("id", "_filter"), f"{tmp_path}/out", f"{tmp_path}/state")
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == kept.distinct().count() <= len(want)
    got = routes.clients_of(kept).select("id", "sub_client", "sub_note")
    assert sorted(map(tuple, got.collect())) == sorted(want * 30)
