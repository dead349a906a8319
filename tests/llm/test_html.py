import html
import re
import time

import numpy as np
import pytest

from tidewire.llm.boosting import fit
from tidewire.llm.dom import parse
from tidewire.llm.html_extract import FAMILIES, _Maker, decode, extract, features, labelled, main_texts, train


def article(page):
    """The text of the article element of the plain pages of the tables."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(t for t in (re.sub(r"\s+", " ", b).strip() for b in blocks) if t)


@pytest.fixture(scope="module")
def model():
    return train(("Some plain sentences stand here. Others follow, with words in them. The end comes soon. " * 5,))


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    assert ((fit(x[:1500], y[:1500]).log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def test_parse_forgives():
    nodes = parse("<p>a<b>b</b>c<p>d &lt;e&gt; f <br>g<script>x</p></script><!-- y --></div>h<li>i<li>j<td")
    assert [x.text for x in nodes if x.tag == "#text"] == ["abc", "d <e> f g", "h", "i", "j"]
    assert [x.tag for x in parse("")] == ["#root"]
    deep = parse("<div>" * 3000 + "x" + "<" * 50)
    assert deep[-1].text.startswith("x") and len(deep) == 3002


def test_quotes_count_only_where_a_value_starts():
    texts = lambda page: [x.text for x in parse(page) if x.tag == "#text"]
    page = "<p title=don't>Hello all</p><p>It's ok & \"fine\"</p><p class='a > b'>End</p>"
    assert texts(page) == ["Hello all", "It's ok & \"fine\"", "End"]
    assert texts('<p title="never closed>One</p><p>Two</p>') == ["One", "Two"]
    assert texts("1 < 2 <3 <p>a</p><!-- x > y --><p/>b<!doctype x><br/>c<p x = y/z>d</p><p") == ["1 < 2 <3", "a", "b c", "d"]
    assert texts("a<!-- never closed <p>b</p>") == ["a"]
    assert texts("<style>p</styles></style >x<script>if (a<b) '</p>'</script>y") == ["xy"]
    tokens = [x.tokens for x in parse("<div id=a'B class=\"sideBar&amp;x\" data-class='z' role = main>")]
    assert tokens[1] == {"a", "b", "side", "bar", "x", "main"}


@pytest.mark.parametrize("unit", ['<a "', "<a '", "<", "<!--", "<a b=\"", "<p ", "</", "<a b='>", "<textarea>", "<style></styl>"])
def test_malformed_pages_take_linear_time(unit):
    start = time.perf_counter()
    parse("<p>first</p>" + unit * (400_000 // len(unit)))
    assert time.perf_counter() - start < 10


def test_held_out_pages(model):
    maker = _Maker(["Other words make this. Nothing is as it was, they say. Trees and rivers. Read it again, now."], seed=123)
    outside = {w for f, ws in FAMILIES.items() if f not in ("main", "header") for w in ws.split()} - set(FAMILIES["main"].split())
    wrong = total = 0
    for _ in range(150):
        nodes, y = labelled(*maker.page(), outside)
        kept = set(decode(nodes, model.log_odds(features(nodes))))
        wrong += len(kept ^ {i for i, x in enumerate(nodes) if x.tag == "#text" and y[i]})
        total += sum(x.tag == "#text" for x in nodes)
    assert wrong / total < 0.03


def test_no_child_without_its_parent():
    nodes = parse("<div><section><p>a</p></section></div><p>b</p>")
    kept = decode(nodes, np.array([1.0, -1, -30, 5, 5, 1, 1]))
    assert [nodes[i].text for i in kept] == ["b"]


def test_parts_are_left_out(model):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies to please you.</div><article><h1>Head &amp; title</h1>"
        "<p>First   words\nof it, with more to say about this thing.</p><p>Second one, which goes on for some time too.</p></article>"
        "<aside class=sidebar><p>Read this as well, it is related.</p></aside>"
        "<div id=comments><p>Nice text, I liked it a lot.</p></div><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"
    )
    want = "Head & title First words of it, with more to say about this thing. Second one, which goes on for some time too."
    assert main_texts([page, ""], model) == [want, ""]


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(want) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == want[r.page_id] for r in got) >= 0.99 * len(want)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "no tags, only text that goes on for a while."), (3, "u", "<p>" + "word " * 200_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract(frame).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id == 1] == ["", ""]
    assert extract(frame.where("1 = 0")).count() == 0
