from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, records, scores, text as tx, urls

AS_OF = datetime(2024, 1, 31)


@pytest.mark.parametrize(
    "text,day",
    [
        ("20240115T103000Z", "2024-01-15"),
        ("2024-01-15T10:30:00Z", "2024-01-15"),
        ("2024-01-15T10:30:00", "2024-01-15"),
        ("2024-01-15", "2024-01-15"),
        ("20240115103000", "2024-01-15"),
        ("garbage", ""),
        ("", ""),
        ("2024-13-45", ""),
    ],
)
def test_seen_date(one, text, day):
    assert one(dates.seen_date(F.col("t")), t=text) == day


def test_rfc822(one):
    assert one(dates.rfc822_date(F.col("t")), t="Mon, 15 Jan 2024 10:30:00 GMT") == "2024-01-15"
    assert one(dates.rfc822_date(F.col("t")), t="nope") is None


@pytest.mark.parametrize(
    "reply,expected",
    [
        ("Geopolitical", ["Geopolitical"]),
        ("geopolitical, nonsense", ["Geopolitical"]),
        ("GEOPOLITICAL, technological competition", ["Geopolitical", "Technological Competition"]),
        ("Uncategorized", ["Uncategorized"]),
        ("geopolitical, uncategorized", ["Uncategorized"]),
        ("", []),
    ],
)
def test_parse_domains(one, reply, expected):
    assert one(tx.parse_domains(F.col("r")), r=reply) == expected


@pytest.mark.parametrize("n,conf", [(0, 0.0), (1, 0.9), (2, 0.7), (3, 0.5), (4, 0.3)])
def test_domain_confidence(one, n, conf):
    assert one(tx.domain_confidence(F.col("d")), d=["x"] * n) == conf


def test_quality_score_is_full(one):
    score = scores.quality(
        F.lit("t" * 25), F.lit("d" * 60), F.lit(6), F.lit("Reuters"), F.lit(AS_OF - timedelta(hours=1)), AS_OF
    )
    assert one(score, x=1) == pytest.approx(1.0)


def test_keywords_keep_first_order(one):
    got = one(tx.keywords(F.col("t")), t="The Border border talks, with talks; über-crisis")
    assert got == ["border", "talks", "über", "crisis"]


def test_categories_first_three(one):
    got = one(tx.categories(F.col("t")), t="trade war, cyber defense and climate diplomacy")
    assert got == ["geopolitics", "conflict", "economy"]


@pytest.mark.parametrize("word,ok", [("Paris", True), ("PARIS", False), ("It", False), ("U.S.", True), ("McDonald", False), ("paris", False)])
def test_entity_candidates(one, word, ok):
    assert one(tx.entity_candidates(F.col("t")), t=word) == ([word] if ok else [])


def test_language_guess(one):
    assert one(tx.guess_language(F.col("t")), t="der Hund und die Katze") == "de"
    assert one(tx.guess_language(F.col("t")), t=" ") == "unknown"


def test_sanitize(one):
    assert one(tx.sanitize(F.col("t"), 10), t="a\x00b  c\n d efghijklmn") == "ab c d ..."


@pytest.mark.parametrize(
    "text,k",
    [
        ('{"k": 1}', 1),
        ('Sure!\n{"k": 2}', 2),
        ('{"k": 3,}', 3),
        ("{k: 4}", 4),
        ("{'k': 5}", 5),
        ("Answer:\n{'k': 6,} bye", 6),
        ('{"s": "a, ]x: \'y\' : z,}", "k": 7,}', 7),
        ("{s: 'it: \"so\", }', k: 8,\n}\nDone.", 8),
        ('{"k": 9', None),
        ("no json", None),
    ],
)
def test_tolerant_json(one, text, k):
    assert one(F.variant_get(records.tolerant_json(F.col("t")), "$.k", "int"), t=text) == k


def test_feed_language(one):
    f = lambda u: one(urls.feed_language(F.col("u")), u=u)
    assert f("https://x.com/rss?q=a&hl=en-US&ceid=DE:de") == "en"
    assert f("https://x.com/rss?q=a&ceid=US:fr") == "fr"
    assert f("https://x.com/rss?q=a") is None


def test_feed_url_coding(one):
    q = urls.feed_url(F.lit(" a b*~ü&c "), F.lit("EN"), F.lit("us"))
    assert one(q, x=1) == "https://news.google.com/rss/search?q=a+b%2A~%C3%BC%26c&hl=en&ceid=US:EN"


@pytest.mark.parametrize(
    "q,ok",
    [("ab cd", True), ("abcd", False), ("a b", False), ("12 345", False), ("bad; query", False), (" two words ", True)],
)
def test_query_text_valid(one, q, ok):
    assert one(records.query_text_valid(F.col("q")), q=q) is ok


def test_redaction_and_fingerprint(one):
    m = F.create_map(F.lit("API_Key"), F.lit("x"), F.lit("note"), F.lit("n" * 150))
    got = one(records.redact(m), x=1)
    assert got == {"API_Key": "[REDACTED]", "note": "n" * 100 + "..."}
    ab = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    ba = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    h = lambda m: one(records.log_fingerprint(F.lit("x"), F.lit("run"), m, m), x=1)
    assert h(ab) == h(ba) and len(h(ab)) == 64


def test_schema_check(one):
    got = one(records.schema_check(F.col("t"), {"a": "string", "b": "number"}), t='{"a": 1, "c": []}')
    assert (got["valid"], got["missing_fields"], got["wrong_type_fields"], got["extra_fields"]) == (
        False, ["b"], ["a"], ["c"],
    )


def test_article_ids_differ(one):
    a = one(records.article_id(F.lit("u1"), F.lit("t"), F.lit(AS_OF)), x=1)
    b = one(records.article_id(F.lit("u2"), F.lit("t"), F.lit(AS_OF)), x=1)
    assert a != b and len(a) == len(b) == 16
