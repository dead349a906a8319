import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.llm.pii import KINDS, Bootstrap, find_personal_data, written

from .conftest import TEXTS

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def random_texts(n):
    rng = random.Random(9)
    parts = ["a.b%c", "@", "x-1", ".", "..", "com", "4785380592391139", "4785 3805-9239 1139", "1", "22", "255", "256", "001.02.3.4",
             "1.2.3.4", "+1 (743) 555-3824", "+", " ", "-", "--", "_", "é😀", "\n", "(", ")", "0", "123456789", "4111111111111111", "a@b.co_d@e.fr"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)]


def test_base_spans_equal_plain_matching(spark, docs, no_docs, sf):
    texts = random_texts(3000) + ["1" * 30000 + " x", "a" * 30000 + "@b.c", "a@b" + ".c" * 20000, "+1" + " " * 30000, "1.2.3.4 " * 3000]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (odd, real, docs):
        source = [(r["doc_id"], joined(plain_spans(r["text"]))) for r in frame.select("doc_id", "text").collect()]
        got = find_personal_data(frame).select("doc_id", written(F.col("base")).alias("b")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(source, key=str)
    assert find_personal_data(no_docs).count() == 0


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, f"Please write to user {i} now. Contact mail: person{i}@site{i}.example.com thanks a lot") for i in range(8)]
    rows += [(100 + i, f"Some prose here. Contact mail: person{i}@localhost9{i}111 thanks a lot") for i in range(3)]
    rows += [(200 + i, f"An order of 12345{i} pieces came in with nothing private") for i in range(30)]
    rows += [(300, "client ip 10.0.0.1 seen"), (301, "client ip 10.0.0.2 seen")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_of_known_values_find_new_ones(taught):
    got = {r["doc_id"]: (r["b"], r["s"]) for r in find_personal_data(taught).select("doc_id", written(F.col("base")).alias("b"), written(F.col("spans")).alias("s")).collect()}
    text = {r["doc_id"]: r["text"] for r in taught.collect()}
    for i in range(3):
        base, spans = got[100 + i]
        assert base == ""
        kind, start, end = spans.split(":")
        assert kind == "email" and text[100 + i][int(start) : int(end)] == f"person{i}@localhost9{i}111"
    for i, (base, spans) in got.items():
        if i < 100 or i >= 200:
            assert base == spans


def test_accepted_values_induce_patterns(spark, taught):
    """Values learned in one context teach a second one, and those found there a third."""
    new = [f"person{i}@localhost9{i}111" for i in range(3)]
    second, third = "fourth@intranet44321", [f"third{i}@lan7{i}555" for i in range(3)]
    rows = [(400 + i, f"Kindly reach via {v} for details soon") for i, v in enumerate([*new, second, *third])]
    rows += [(450 + i, f"Bounced back from {v} at night twice") for i, v in enumerate([*third, "last@host80808"])]
    rows += [(470, "Bounced early with 5551234567 by noon")]
    more = taught.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in find_personal_data(more, Bootstrap(confidence=0.3)).select("doc_id", written(F.col("spans")).alias("s")).collect()}
    for doc, text in rows[:-1]:
        value = next(w for w in text.split() if "@" in w)
        assert got[doc] == f"email:{text.index(value)}:{text.index(value) + len(value)}"
    assert got[470] == "" and all(got[200 + i] == "" for i in range(30))
    # The surer patterns must be, the less they spread: one open value among three learned ones is taken.
    few = taught.unionByName(spark.createDataFrame(rows[:4], "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in find_personal_data(few).select("doc_id", written(F.col("spans")).alias("s")).collect()}
    assert got[403] == f"email:17:{17 + len(second)}"


def test_digest_of_no_spans():
    assert joined(plain_spans(None)) == "" and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
    assert TEXTS[1][1] is None
