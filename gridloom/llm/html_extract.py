"""Operator 5, HTML extraction: score containers by their paragraphs and keep the best one with its siblings.

A page is read into a tree. Subtrees that are never main text (scripts, forms, menus, page headers and footers, asides, and
elements whose class or id says advert, sidebar, notice, comments and the like) are left out. Each paragraph then gives points for its
length and its commas to its parent in full and to its grandparent by half; a container's points are
discounted by its link density and start with a bonus for ``article`` and ``main``. The best container is kept, with
those siblings that score near it; or, if it lies in an ``article`` or ``main`` with few links, all of that. Its blocks are joined in page order.

Pages are independent: one Arrow pass, no shuffle, memory bounded by a batch.

Defined cases: null or empty html, and a page without text, give the empty text; unclosed and misnested tags are
closed by what follows; of containers with equal scores the first in the page counts, an outer before an inner one; repeated rows are treated alike; an empty table gives an empty table; columns other than
``page_id``, ``url`` and ``html`` are never read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import in_arrow

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|</\s*(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<loose>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("script style noscript iframe nav footer aside form button select option textarea svg canvas object embed template head title menu dialog input audio video map".split())
#: Words of a class, id or role that mark what is not main text.
ODD = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus replies cookie cookies consent notice notices popup modal overlay share sharing social related "
    "recommended newsletter subscribe signup login widget toolbar pagination pager masthead complementary contentinfo search".split()
)
#: An open element of the first kind ends where one of the second starts.
IMPLIED = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
#: Implied ends look no further out than these.
SCOPES = frozenset("html body table td th ul ol dl article section div aside nav main blockquote".split())
BONUS = {"article": 50.0, "main": 30.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0}


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    parent: Node | None
    odd: bool = False
    items: list = field(default_factory=list)  # texts and nodes, in order
    score: float = 0.0
    chars: int = 0
    linked: int = 0


def parse(page: str) -> Node:
    root = Node("html", None)
    at, pos, end = root, 0, len(page)
    while pos < end:
        m = _MARKUP.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text:
            at.items.append(html.unescape(text))
        if not m:
            break
        pos = m.end()
        if name := m["end"]:
            name, up = name.lower(), at
            while up.parent is not None and up.tag != name:
                up = up.parent
            if up.tag == name and up.parent is not None:
                at = up.parent
            continue
        if m["cdata"] is not None:
            at.items.append(m["cdata"])
            continue
        if not (name := (m["start"] or m["loose"])):
            continue
        name = name.lower()
        if name in ("html", "body"):
            if name == "body":
                while at.tag in ("head", "p") and at.parent is not None:
                    at = at.parent
            continue
        up = at
        while up.parent is not None and up.tag not in SCOPES | {"li", "td", "th", "dt", "dd"} | IMPLIED.keys():
            up = up.parent
        while up.parent is not None and up.tag in IMPLIED and name in IMPLIED[up.tag]:
            at = up = up.parent
        attrs = m["attrs"] or ""
        marks = " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)) if "=" in attrs else ""
        odd = bool(marks) and not ODD.isdisjoint(re.split(r"[\s_-]+", marks.lower()))
        node = Node(name, at, odd and name not in ("article", "main"))
        at.items.append(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        at = node
    return root


def _spare(root: Node) -> None:
    """A class or id does not count on an element with most of the page's unlinked text, if no article or heading is outside of it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if not isinstance(x, str) and x.tag not in DROPPED)
    if not any(x.odd for x in order):
        return
    plain: dict[int, int] = {}
    heads: dict[int, int] = {}
    for node in reversed(order):
        below = [x for x in node.items if not isinstance(x, str) and id(x) in plain]
        plain[id(node)] = sum(len(x.strip()) for x in node.items if isinstance(x, str)) + sum(plain[id(x)] for x in below if x.tag != "a")
        heads[id(node)] = 0 if node.tag == "header" else (node.tag in ("article", "main", "h1")) + sum(heads[id(x)] for x in below)
    text, n = plain[id(root)], heads[id(root)]
    for node in order:
        if node.odd and heads[id(node)] == n and plain[id(node)] > (0.5 if n else 0.9) * text:
            node.odd = False


def _kept(node: Node) -> bool:
    if node.tag in DROPPED or node.odd:
        return False
    if node.tag == "header":  # of the page, unless it heads the article itself
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is not None
    return True


def _prune(root: Node) -> list[Node]:
    """Removes what is never main text; returns the rest, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.items = [x for x in node.items if isinstance(x, str) or _kept(x)]
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return order


def _measure(order: list[Node]) -> None:
    """Characters and linked characters of each subtree, then points of paragraphs for their containers."""
    inline: dict[int, tuple[int, int]] = {}  # characters and commas outside of the blocks below
    for node in reversed(order):
        chars = commas = 0
        for x in node.items:
            if isinstance(x, str):
                n = len(x.strip())
                node.chars += n
                more = (n, x.count(","))
            else:
                node.chars += x.chars
                node.linked += x.chars if x.tag == "a" else x.linked
                more = (0, 0) if x.tag in BLOCKS else inline[id(x)]
            if more[0]:
                chars, commas = chars + more[0] + bool(chars), commas + more[1]
        inline[id(node)] = chars, commas
    for node in order:
        if node.tag not in BLOCKS:
            continue
        chars, commas = inline[id(node)]
        if not chars:
            continue
        points = 1 + commas + min(chars / 100, 3.0)
        target = node if node.tag in BONUS else node.parent
        if target is not None:
            target.score += points
            if target.parent is not None:
                target.parent.score += points / 2
    for node in order:
        node.score = (node.score + BONUS.get(node.tag, 0.0)) * (1 - node.linked / max(node.chars, 1)) if node.chars else 0.0


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below, in order, white space as one space each."""
    found: list[str] = []
    run: list[str] = []

    def close() -> None:
        if words := "".join(run).split():
            found.append(" ".join(words))
        run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        else:
            block = x.tag in BLOCKS
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(x.items))
    close()
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    order = _prune(root)
    _measure(order)
    containers = [n for n in order if n.tag in BONUS or n is root]
    best = max(containers, key=lambda n: n.score if n is not root else n.score * 0.5)
    if best.score <= 0:
        best = root
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and up is not best and up.linked <= 0.2 * up.chars:
        best = up  # however long the page, its heading and short sections stay
    kept = [best]
    if best.parent is not None:
        bar = max(10.0, best.score * 0.3)
        alike = lambda n: n.tag == best.tag and n.tag in ("article", "section", "div") and n.score - BONUS[n.tag] >= bar
        prose = lambda n: n.tag == "p" and n.chars > 80 and n.linked < 0.25 * n.chars
        kept = [n for n in best.parent.items if n is best or (not isinstance(n, str) and (alike(n) or prose(n)))]
    return " ".join(b for n in kept for b in _blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return in_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
