"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import functools
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.boosting import Boosted, fit
from tidewire.llm.dom import Node, parse

#: Words in class, id and role attributes by what they tell.
FAMILIES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pager pagination toolbar tabs toc skip topbar",
    "header": "header head masthead banner logo branding top hero",
    "footer": "footer foot bottom copyright colophon legal contentinfo",
    "side": "sidebar side aside rail related recommended widget complementary trending popular more links tags",
    "notice": "notice alert cookie cookies consent gdpr popup modal overlay message warning announcement disclaimer toast paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense outbrain taboola",
    "form": "form search subscribe newsletter signup login register input contact comment_form",
    "comment": "comment comments reply replies discussion disqus respond feedback reader responses thread",
    "share": "share sharing social facebook twitter follow",
    "main": "article content main post entry story body text articlebody maincontent prose blog news page",
}
TAGS = (
    "#text", "p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "ul ol dl", "li dt dd",
    "h1", "h2 h3 h4 h5 h6", "table tbody thead tfoot tr", "td th", "blockquote pre figure figcaption", "body", "html #root", "head",
    "button fieldset label dialog address details summary menu",
)
_TAG_INDEX = {t: i for i, group in enumerate(TAGS) for t in group.split()}
_FAMILY_OF = {}
for _i, _words in enumerate(FAMILIES.values()):
    for _w in _words.split():
        _FAMILY_OF.setdefault(_w, _i)
N_FEATURES = len(TAGS) + 1 + 2 * len(FAMILIES) + 16
#: Pages whose texts are used to make the training trees, and the trees made; both bound what is fitted.
TRAIN_PAGES, TRAIN_TREES = 40, 450


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: tag, attribute tokens of it and its ancestors, size and density of its subtree, depth, siblings."""
    n, k = len(nodes), len(TAGS) + 1
    out = np.zeros((n, N_FEATURES))
    parent = np.fromiter((x.parent for x in nodes), np.int64, n)
    children = [0] * n
    place = [0] * n
    for i, node in enumerate(nodes):
        out[i, _TAG_INDEX.get(node.tag, k - 1)] = 1
        for token in node.tokens:
            f = _FAMILY_OF.get(token)
            if f is not None:
                out[i, k + f] = 1
        if i:
            p = node.parent
            place[i], children[p] = children[p], children[p] + 1
            # Nearness in the tree: an ancestor's token counts less with each step.
            out[i, k + len(FAMILIES) : k + 2 * len(FAMILIES)] = 0.8 * np.maximum(
                out[p, k : k + len(FAMILIES)], out[p, k + len(FAMILIES) : k + 2 * len(FAMILIES)]
            )
    chars = np.array([sum(map(len, x.texts)) for x in nodes], dtype=float)
    linked = np.array([x.linked for x in nodes], dtype=float)
    marks = np.array([x.marks for x in nodes], dtype=float)
    stops = np.array([sum(t.count(".") + t.count(",") for t in x.texts) for x in nodes], dtype=float)
    blocks = np.array([x.tag == "#text" for x in nodes], dtype=float)
    below = np.ones(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        stops[p] += stops[i]
        blocks[p] += blocks[i]
        below[p] += below[i]
    rest = out[:, k + 2 * len(FAMILIES) :]
    up = np.maximum(parent, 0)
    columns = (
        np.log1p(chars), linked / np.maximum(chars, 1), np.log1p(below), chars / below, chars / np.maximum(blocks, 1),
        stops / np.maximum(chars, 1) * 100, np.array([x.depth for x in nodes]), np.array(place), np.array(children)[up],
        np.array(place) / np.maximum(np.array(children)[up], 1), chars / np.maximum(chars[0], 1), chars / np.maximum(chars[up], 1),
        marks / np.maximum(chars, 1) * 100, np.arange(n) / n,
        np.array([_TAG_INDEX.get(nodes[p].tag, k - 1) for p in up]), np.array(children),
    )
    for j, column in enumerate(columns):
        rest[:, j] = column
    return out


#: Gain of plain text elements for being kept as their parent is: such a part of an article is rarely foreign.
STAY = 2.0
_PLAIN = frozenset("#text p h1 h2 h3 h4 h5 h6 li ul ol dd dt td tr table blockquote pre".split())
_OUTER = frozenset("#root html body".split())


def stay(nodes: list[Node]) -> np.ndarray:
    plain = [i > 0 and x.tag in _PLAIN and not x.tokens and nodes[x.parent].tag not in _OUTER for i, x in enumerate(nodes)]
    return STAY * np.array(plain)


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[int]:
    """Kept text nodes of the best labelling in which nothing below a dropped node is kept.

    Leaving a node out leaves its subtree out. From the leaves up, each node compares the gain of
    keeping it, its log-odds, ``stay`` and its children's best gains, with dropping all of it, which
    gains nothing; from the root down the choices are read off.
    """
    gain = (log_odds + stay(nodes)).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [False] * len(nodes)
    out = []
    for i, node in enumerate(nodes):
        kept[i] = i == 0 or (kept[node.parent] and gain[i] > 0)
        if kept[i] and node.tag == "#text":
            out.append(i)
    return out


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    """Per page the texts of the kept blocks in page order, joined by a blank. All nodes are scored at once."""
    trees = [parse(page) for page in pages]
    scores = model.log_odds(np.concatenate([features(nodes) for nodes in trees]))
    out, at = [], 0
    for nodes in trees:
        kept = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(t for t in (nodes[i].text for i in kept) if t))
    return out


class _Maker:
    """Makes labelled pages: an article among menus, notices and other parts, in many shapes."""

    def __init__(self, texts: list[str], seed: int = 7):
        self.rng = random.Random(seed)
        self.sentences = [s.strip() for t in texts for s in t.replace("\n", " ").split(".") if len(s) > 8][:5000]
        if not self.sentences:
            self.sentences = ["Some words stand here", "Others follow, as they do", "A third line ends it"]

    def prose(self, n: int) -> str:
        said = self.rng.choices(self.sentences, k=n)
        return html_escape(". ".join(said) + ".")

    def words(self, n: int) -> str:
        return html_escape(" ".join(self.rng.choice(self.sentences).split()[:n]))

    def named(self, family: str) -> str:
        """An attribute with a word of the family, or none."""
        word = self.rng.choice(FAMILIES[family].split())
        name = self.rng.choice(["class", "class", "id", "role"])
        extra = self.rng.choice(["", "", "box ", "wrapper "])
        return f' {name}="{extra}{word}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(self.rng.randint(1, 4))}</a></li>' for _ in range(n))

    def part(self, family: str) -> str:
        """A part that is not the article."""
        r = self.rng
        tag = {"menu": "nav", "footer": "footer", "header": "header", "side": "aside", "form": "form"}.get(family)
        tag, attribute = (tag, r.choice(["", self.named(family)])) if tag and r.random() < 0.6 else (r.choice(["div", "section", "ul" if family == "menu" else "div"]), self.named(family))
        inner = {
            "menu": lambda: f"<ul>{self.links(r.randint(2, 9))}</ul>",
            "header": lambda: f"<a href='/'>{self.words(2)}</a>" + r.choice(["", f"<h2>{self.words(3)}</h2>", f"<p>{self.words(6)}</p>"]),
            "footer": lambda: f"&copy; {self.words(2)} &middot; <a href='/a'>{self.words(1)}</a>" + r.choice(["", f"<p>{self.prose(1)}</p>"]),
            "side": lambda: f"<h3>{self.words(2)}</h3>" + r.choice([f"<ul>{self.links(r.randint(2, 6))}</ul>", f"<p>{self.prose(r.randint(1, 4))}</p>"]),
            "notice": lambda: r.choice([self.prose(1), f"<p>{self.prose(r.randint(1, 3))}</p><button>{self.words(1)}</button>"]),
            "advert": lambda: r.choice([self.prose(1), self.words(6), f"<p>{self.prose(r.randint(1, 2))}</p>", f"<a href='/b'>{self.words(5)}</a>"]),
            "form": lambda: f"<label>{self.words(2)}</label><input name='q'><button>{self.words(1)}</button>" + r.choice(["", f"<p>{self.prose(1)}</p>"]),
            "comment": lambda: r.choice(["", f"<h3>{self.words(2)}</h3>"]) + "".join(f"<div{r.choice(['', self.named('comment')])}><p>{self.prose(r.randint(1, 4))}</p></div>" for _ in range(r.randint(1, 5))),
            "share": lambda: f"<ul>{self.links(3)}</ul>",
        }[family]()
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def page(self) -> tuple[str, str]:
        """A page, and the mark that its article's container has as data-is-main."""
        r = self.rng
        paragraphs = r.choice([1, 1, 2, 3, 5, 8, 14, 30, 60])
        body = []
        for _ in range(paragraphs):
            kind = r.random()
            if kind < 0.72:
                body.append(f"<p>{r.choice(['', '<b>' + self.words(2) + '</b> '])}{self.prose(r.randint(1, 6))}" + r.choice(["</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                body.append(f"<p>{self.words(r.randint(1, 3))}.</p>")
            elif kind < 0.86:
                body.append(f"<h2>{self.words(4)}</h2>")
            elif kind < 0.92:
                body.append("<ul>" + "".join(f"<li>{self.prose(1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.96:
                body.append(f"<blockquote><p>{self.prose(2)}</p></blockquote>")
            else:
                body.append(f"<table><tr><td>{self.words(2)}</td><td>{self.words(2)}</td></tr></table>")
        if r.random() < 0.25:
            body.insert(r.randrange(len(body) + 1), self.part(r.choice(["advert", "share", "side", "notice", "form"])))
        if r.random() < 0.12:
            body.append(self.part("comment"))
        head = r.choice([f"<h1>{self.words(6)}</h1>"] * 3 + ["", f"<header><h1>{self.words(6)}</h1></header>"])
        inner = head + "".join(body)
        container = r.random()
        if container < 0.5:
            main = f"<article{r.choice(['', '', self.named('main')])} data-is-main>{inner}</article>"
        elif container < 0.65:
            main = f"<main data-is-main>{inner}</main>"
        else:
            main = f"<{(t := r.choice(['div', 'section']))}{self.named('main')} data-is-main>{inner}</{t}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            main = f"<{(t := r.choice(['div', 'main', 'section']))}{r.choice(['', self.named('main'), ' class=\"wrapper\"'])}>{main}</{t}>"
        before = [self.part(r.choice(["menu", "header", "notice", "advert", "form"])) for _ in range(r.choice([0, 1, 2, 3]))]
        after = [self.part(r.choice(["footer", "side", "comment", "advert", "form", "share", "comment"])) for _ in range(r.choice([0, 1, 2, 3]))]
        return f"<html><head><title>{self.words(4)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", "data-is-main"


def html_escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def labelled(page: str, mark: str, outside: set[str]) -> tuple[list[Node], np.ndarray]:
    """Nodes and classes: 1 for the marked container, what leads to it, and what is in it but no inserted part."""
    nodes = parse(page.replace(f" {mark}", f' id="{mark.replace("-", "")}"'))
    token = frozenset(("dataismain",))
    y = np.zeros(len(nodes))
    middle = next(i for i, x in enumerate(nodes) if token <= x.tokens)
    nodes[middle].tokens = nodes[middle].tokens - token
    for i in range(middle, len(nodes)):
        inside = i == middle or (nodes[i].parent >= middle and y[nodes[i].parent] == 1)
        foreign = nodes[i].tag in ("aside", "form", "nav", "footer", "button", "label") or bool(nodes[i].tokens & outside)
        y[i] = inside and (i == middle or not foreign)
    i = middle
    while i > 0:
        i = nodes[i].parent
        y[i] = 1
    return nodes, y


@functools.lru_cache(maxsize=4)
def train(texts: tuple[str, ...], trees: int = TRAIN_TREES, seed: int = 7) -> Boosted:
    """Fit the node classifier on ``trees`` pages made from the given texts' sentences."""
    maker = _Maker(list(texts), seed)
    outside = {w for f, words in FAMILIES.items() if f not in ("main", "header") for w in words.split()} - set(FAMILIES["main"].split())
    xs, ys = [], []
    for _ in range(trees):
        nodes, y = labelled(*maker.page(), outside)
        xs.append(features(nodes))
        ys.append(y)
    return fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of ``pages`` (page_id, url, html).

    The classifier is fitted on the driver on made-up pages whose sentences come from at most
    ``train_pages`` pages; it is small and fixed in size. Null html counts as empty, and empty text is
    the result where nothing is kept. Rows in any number and order; no shuffle.
    """
    known = [r[0] for r in pages.select(F.substring("html", 1, 20000).alias("h")).where("h is not null").head(train_pages)]
    texts = tuple(" ".join(x.text for x in parse(page) if x.tag == "#text" and not x.linked) for page in known)
    shared = pages.sparkSession.sparkContext.broadcast(train(texts))

    @F.pandas_udf("string")
    def text_of(batch: pd.Series) -> pd.Series:
        pages, step = batch.tolist(), 100
        return pd.Series([t for at in range(0, len(pages), step) for t in main_texts(pages[at : at + step], shared.value)])

    whole = pages.select("page_id", "url", text_of(F.coalesce("html", F.lit(""))).alias("text"))
    return whole.withColumn("n_chars", F.length("text").cast("long"))
