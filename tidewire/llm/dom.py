"""A forgiving HTML reader: nodes of a page, their texts and features."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
#: What an opening tag ends if it is open: an element without end tag.
ENDS = {
    **{t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    **{t: {"tr", "td", "th", "p"} for t in ("tbody", "thead", "tfoot")},
}
#: An open element that keeps what lies outside it from being ended.
FENCE = frozenset("body html article aside section main div table ul ol dl nav header footer form td th blockquote".split())

_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: One step inside a tag: blanks and slashes, an attribute name, or the sign before a value.
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s=/>]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[a-z]+|[0-9]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Node:
    """An element, or a block of text (tag #text) made of neighbouring inline content."""

    tag: str
    parent: int
    depth: int
    tokens: frozenset[str] = frozenset()
    texts: list[str] = field(default_factory=list)
    linked: int = 0
    marks: int = 0

    @property
    def text(self) -> str:
        return _BLANK.sub(" ", html.unescape("".join(self.texts))).strip()


def attribute_tokens(attributes: list[tuple[str, str]]) -> frozenset[str]:
    """Lower-case parts of class, id, role, itemprop and aria-label; camel case is cut."""
    out: set[str] = set()
    for name, value in attributes:
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            cut = re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(value))
            out.update(_PART.findall(cut.lower()))
    return frozenset(out)


class _Scanner:
    """Finds the tags of a page from left to right.

    Quotes count only where a value starts, so an apostrophe inside an unquoted value is part of it. A quote
    that never ends is an ordinary character: its tag ends at the next ``>``. What the rest of the page does
    not hold is looked for once only, so the work is linear in the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Next place of ``what``, -1 if there is none from here on."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag(self, at: int) -> tuple[int, bool, str, list[tuple[str, str]], bool] | None:
        """(end, closing, name, attributes, self-closing) of what starts at the ``<`` at ``at``.

        The name is empty for comments and declarations; None where the sign is text. An end of -1 means
        that the page ends inside the tag.
        """
        page = self.page
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                return page.index(">", at) + 1, False, "", [], False
            end = self.find("-->", at + 4)
            return (end + 3 if end >= 0 else -1), False, "", [], False
        if page.startswith(("<!", "<?"), at):
            end = self.find(">", at)
            return (end + 1 if end >= 0 else -1), False, "", [], False
        m = _NAME.match(page, at + 1)
        if not m:
            return None
        if self.find(">", m.end()) < 0:
            return -1, False, "", [], False
        at, n, found = m.end(), len(page), []
        while True:
            at = _GAP.match(page, at).end()
            if at >= n:
                return -1, False, "", [], False
            if page[at] == ">":
                return at + 1, bool(m[1]), m[2].lower(), found, page[at - 1] == "/"
            key = _KEY.match(page, at)
            at = key.end()
            sign = _IS.match(page, at)
            if not sign:
                found.append((key[0], ""))
                continue
            at = sign.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = self.find(quote, at + 1)
                if end < 0:
                    end = self.find(">", at)
                    if end < 0:
                        return -1, False, "", [], False
                    found.append((key[0], page[at + 1 : end]))
                    at = end
                else:
                    found.append((key[0], page[at + 1 : end]))
                    at = end + 1
            else:
                value = _BARE.match(page, at)
                found.append((key[0], value[0]))
                at = value.end()


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; node 0 is the root. Reads each character of the page once.

    Script, style and the like are dropped with their content, comments too. Inline elements belong to
    the block of text they stand in; a line break there is a blank.
    """
    nodes = [Node("#root", -1, 0)]
    stack, anchors, block = [0], 0, None

    def write(raw: str) -> None:
        nonlocal block
        if block is None:
            if not raw or raw.isspace():
                return
            nodes.append(Node("#text", stack[-1], len(stack)))
            block = nodes[-1]
        block.texts.append(raw)
        if anchors:
            block.linked += len(raw)

    scan, raw_end = _Scanner(page), {}
    at, n, text_from = 0, len(page), 0
    while at < n:
        start = scan.find("<", at)
        found = scan.tag(start) if start >= 0 else None
        if start >= 0 and found is None:
            at = start + 1
            continue
        stop = start if start >= 0 else n
        if stop > text_from:
            write(page[text_from:stop])
        # A tag cut off at the end of the page is no text.
        if start < 0 or found[0] < 0:
            text_from = n
            break
        at, closing, tag, attributes, alone = found
        text_from = at
        if not tag:
            continue
        if tag in RAW:
            if not closing and not alone:
                if tag not in raw_end:
                    raw_end[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
                end = raw_end[tag] and raw_end[tag].search(page, at)
                if not end:
                    raw_end[tag] = None
                at = text_from = end.end() if end else n
            if tag not in ("script", "style", "noscript", "template"):
                block = None
            continue
        if tag == "br":
            write(" " if block is not None else "")
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            if block is not None:
                block.marks += not closing
            continue
        block = None
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            anchors = 0
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            open_tag = nodes[stack[k]].tag
            if open_tag in ends:
                del stack[k:]
                break
            if open_tag in FENCE:
                break
        nodes.append(Node(tag, stack[-1], len(stack), attribute_tokens(attributes) if attributes else frozenset()))
        if not alone:
            stack.append(len(nodes) - 1)
    if text_from < n:
        write(page[text_from:])
    return nodes
