import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewire.llm import ngram_quality as nq
from tidewire.llm.quality_rules import cascade, keep_passing, ordered_by_gain, quality_verdicts, rule_order, sampled, text_rules

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_and_base_rules(spark, docs, no_docs, sf):
    rng = random.Random(4)
    phrase = " ".join(f"p{i}" for i in range(11))
    odd = [(i, " ".join(rng.choice([phrase, "x y", "\n", "a|b", "\t", f"q{rng.random()}"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    odd += [(900, "w " * 30000), (901, " ".join(f"u{i % 4000}" for i in range(12000)))]
    for frame in (spark.createDataFrame(odd, "doc_id long, text string"), spark.read.parquet(f"{sf}/documents.parquet"), docs):
        got = quality_verdicts(frame).select("doc_id", "text", *COUNTS, "base_failed", "kept").collect()
        assert len(got) == frame.count()
        for r in got:
            want = plain_counts(r.text)
            assert tuple(r[c] for c in COUNTS) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.base_failed and r.kept)
    assert quality_verdicts(no_docs).count() == 0


def test_clean_labelled_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    kept = keep_passing(docs)
    assert kept.columns == docs.columns
    judged = quality_verdicts(docs.join(labels, "doc_id"))
    assert judged.where("not kept and not base_failed").count() == 0
    assert kept.count() == quality_verdicts(docs).where("kept").count()


def test_order_by_rejection_per_cost(spark):
    sample = spark.range(2000).select(F.lit("Some words").alias("text"), F.lit(10).alias("word_chars"), F.lit(0).alias("n_symbols"), F.lit(2).alias("n_words"), F.lit(0).alias("n_dup_lines"))
    order = ordered_by_gain(sample, text_rules())
    gains = [share / cost for _, share, cost in order]
    assert gains == sorted(gains, reverse=True) and len(order) == len(text_rules())
    rules = [r for r, _, _ in order]
    one = cascade(sample, rules).where("failed_rule is null").count()
    assert one == cascade(sample, rules[::-1]).where("failed_rule is null").count()


def test_order_is_the_same_however_the_table_lies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    loud = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!" * 9000))).otherwise(F.col("text")))
    want = [r.name for r in rule_order(loud, rows=200)]
    # The long runs of marks make long words, which cost nothing to see; then marks before regular expressions.
    assert want[0] == "word_length" and want.index("exclamations") < want.index("capitals")
    assert [r.name for r in rule_order(loud.orderBy(F.rand(3)).repartition(7), rows=200)] == want
    seen = sampled(docs, rows=200).count()
    assert 120 < seen < 300 and sampled(docs, rows=10**6).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    # Copies, nulls and no rows at all.
    same = spark.range(5000).select(F.lit("one text").alias("text")).unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    assert sampled(same).count() <= 2 and len(rule_order(same)) == len(rule_order(same.where("1 = 0"))) == len(text_rules())


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in nq.classify(docs, learn).collect()}
    assert len(got) == docs.count()
    held = labels.where("doc_id % 2 = 1").collect()
    good = [got[r.doc_id] for r in held if r.quality == 1]
    bad = [got[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)
    assert nq.keep_good(docs, labels).columns == docs.columns


def test_classifier_on_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (7, 0, 0), (10, 1, None)], "doc_id long, quality int, toxic int")
    got = nq.classify(docs, labels).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.n_symbols == 0)
    assert all(r.kept for r in nq.classify(docs, labels.where("1 = 0")).collect() if r.n_symbols)
    assert nq.classify(no_docs, labels).count() == 0 and nq.keep_good(docs, labels).columns == docs.columns
