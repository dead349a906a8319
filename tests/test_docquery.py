from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import docquery as dq

AS_OF = datetime(2024, 1, 31)


@pytest.mark.parametrize(
    "text,hit",
    [("a x b", True), ("a x x b", False), ("a x x b a", True), ("b a", True), ("a a a", False), ("", False)],
)
def test_near(one, text, hit):
    assert one(dq.near(F.col("t"), 2, "a", "b"), t=text) is hit


def test_near_three_words_slides(one):
    c = dq.near(F.col("t"), 3, "a", "b", "c")
    assert one(c, t="a x x x b a c") is True
    assert one(c, t="a x b x x c") is False


def test_repeat_and_keyword(one):
    assert one(dq.repeat(F.col("t"), 2, "War"), t="war and WAR") is True
    assert one(dq.repeat(F.col("t"), 2, "war"), t="warship war") is False
    assert one(dq.keyword(F.col("t"), "trade war; nothing"), t="The Trade War.") is True
    assert one(dq.keyword(F.col("t"), "trade war"), t="trade warship") is False


def test_tone(one):
    assert one(dq.tone(F.col("v"), ">5"), v=5.0) is False
    assert one(dq.tone(F.col("v"), "<-5"), v=-5.5) is True
    assert one(dq.tone(F.col("v"), ">5", absolute=True), v=-5.5) is True


@pytest.mark.parametrize("bad", ["=5", ">=5", "5", ">x"])
def test_bad_tone(bad):
    with pytest.raises(ValueError):
        dq.tone(F.lit(1.0), bad)


def test_argument_checks():
    with pytest.raises(NotImplementedError):
        dq.tone(F.lit(1.0), [">1"])
    with pytest.raises(ValueError):
        dq.near(F.lit("x"), 3, "one")
    with pytest.raises(ValueError):
        dq.repeat(F.lit("x"), 3, "two words")
    with pytest.raises(ValueError):
        dq.multi_repeat(F.lit("x"), [(1, "a")], "XOR")
    for span in ("30min", "5x", "d", "5"):
        with pytest.raises(ValueError):
            dq.timespan_start(span, AS_OF)
    assert dq.timespan_start("90min", AS_OF) == datetime(2024, 1, 30, 22, 30)
    assert dq.timespan_start("2w", AS_OF) == datetime(2024, 1, 17)


def test_search_needs_one_period(spark):
    df = spark.createDataFrame([(1, AS_OF)], "id long, published_at timestamp")
    with pytest.raises(ValueError):
        dq.search(df, AS_OF)
    with pytest.raises(ValueError):
        dq.search(df, AS_OF, start_date=AS_OF, end_date=AS_OF, timespan="1d")
    with pytest.raises(ValueError):
        dq.search(df, AS_OF, start_date=AS_OF)
    assert dq.search(df, AS_OF, timespan="1d").count() == 1
