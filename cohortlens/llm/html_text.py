"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags.  A linear classifier over a
block's text, links and place gives its costs as content and as boilerplate:
the capacities of its edges to the two terminals.  Blocks next to each other,
and blocks with the same parent, are joined by edges that are the stronger the
nearer they stand in the DOM.  The minimum cut separates content from
boilerplate with the least cost of all labellings; maximum flow finds it.

Defined cases: null or blank html, and pages without content, give an empty
text; unclosed comments, scripts and styles end with the page, other elements that are
not shown (template, object and so on) with the element around them, selections, buttons
and drawings also before the next block; a self-closing element holds nothing; formulas
are text; repeated rows are extracted each; null page_id or url is kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read

# HTML elements by their part in a page, and names that sites give.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACE_TAGS = frozenset("br td th option wbr img input".split())
UNSEEN_TAGS = frozenset("script style noscript template title svg iframe object canvas audio video map textarea select button".split())
BLOCKLESS_TAGS = frozenset("select button svg".split())  # hold no blocks, so a block ends them
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe")
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes".split() + list(RAW_TAGS))  # don't end the head
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
OUTSIDE_NAMES = frozenset("ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar comment comments reply replies discussion disqus share sharing social related recommended recommendations popular newsletter subscribe subscription signup popup modal overlay widget login search pagination pager copyright disclaimer legal tags skip form".split())
ABOUT_NAMES = frozenset("with without has no".split())  # what follows in a class says what the page has, not what the element is
OF_NAMES = frozenset("of for about".split())  # in a class, they make a phrase about the text
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CONTENT_NAMES = frozenset("article articlebody content entry post story main text body prose".split())

# Weights of the classifier (positive: content) and of the edges.
BIAS, IN_CONTENT, CONTENT_NAME, OUTSIDE, PARAGRAPH, HEADING, LINKS, PER_WORD, LONG = -1.0, 3.0, 1.0, -9.0, 1.0, 0.5, -4.0, 0.35, 12
LINKS_INSIDE = 0.5  # factor of LINKS in an article, whose lists of links are mostly its own
SMOOTHNESS, MARKED, SCALE = 2.0, 0.1, 1000  # MARKED: factor of edges from a marked part of the page to another

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<[!?/][^>]*>|<(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """An open element: its parent and what its ancestors and itself say of the text in it."""

    __slots__ = ("tag", "number", "parent", "depth", "named", "hidden", "marked", "in_content", "in_header", "in_outside")

    def __init__(self, tag: str, number: int, parent: Element | None, outside: bool = False, named: bool = False, hidden: bool = False) -> None:
        up = parent or self
        if parent is None:
            self.depth, self.named, self.hidden, self.marked = -1, False, False, False
            self.in_content = self.in_header = self.in_outside = False
        self.tag, self.number, self.parent, self.depth = tag, number, parent, up.depth + 1
        self.named, self.hidden = up.named or named, up.hidden or hidden
        # names around the article are those of the page's layout
        self.marked = outside if tag in CONTENT_TAGS else up.marked or outside
        self.in_content, self.in_header, self.in_outside = up.in_content or tag in CONTENT_TAGS, up.in_header or tag == "header", up.in_outside or tag in OUTSIDE_TAGS

    @property
    def outside(self) -> bool:
        """A header outside the article is the site's; one inside is the article's."""
        return self.hidden or self.marked or self.in_outside or self.in_header and not self.in_content


class Block(NamedTuple):
    """``at``: the element that holds the text, ``linked``: characters of it in links."""
    text: str
    linked: int
    at: Element


def _names(value: str) -> set[str]:
    """Names in a class or id; of ``with-right-sidebar`` none."""
    found: set[str] = set()
    for token in value.split():
        names = [n.lower() for n in _NAME.findall(token)]
        if not OF_NAMES.isdisjoint(names):
            continue
        found.update(names[:next((i for i, n in enumerate(names) if n in ABOUT_NAMES), len(names))])
    return found


def _named(attrs: str) -> tuple[bool, bool, bool]:
    """(outside, content, hidden): the first two by class, id and role."""
    outside = content = hidden = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key == "role":
            outside |= value.lower() in OUTSIDE_ROLES
            content |= value.lower() in ("main", "article")
        elif key in ("class", "id"):
            names = _names(value)
            outside |= bool(names & OUTSIDE_NAMES)
            content |= bool(names & CONTENT_NAMES)
    return outside, content, hidden


def blocks(html: str) -> list[Block]:
    """Text blocks of a page, in order."""
    out: list[Block] = []
    root = Element("html", 0, None)
    stack = [root]
    unseen: list[tuple[str, int]] = []  # open elements that are not shown, and the depth they stand at
    text: list[str] = []
    linked = links = number = 0
    in_head = False

    def flush() -> None:
        nonlocal text, linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, min(linked, len(joined)), stack[-1]))
        text, linked = [], 0

    def close(depth: int) -> None:
        """The open elements beyond ``depth`` end, and what is not shown in them."""
        del stack[depth:]
        while unseen and unseen[-1][1] > depth:
            unseen.pop()

    at = 0
    for m in _TOKEN.finditer(html):
        in_head = in_head and not html[at:m.start()].strip()
        if not unseen and not in_head and m.start() > at:
            text.append(piece := html[at:m.start()])
            linked += len(piece.strip()) if links else 0
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "head":
            in_head = not m["close"]
        elif tag not in HEAD_TAGS:
            in_head = False  # </head> and <body> may be left out
        if tag == "a":
            links = 0 if m["close"] else 1
        elif tag in SPACE_TAGS:
            text.append(" ")
        elif tag in UNSEEN_TAGS:
            if m["close"]:
                last = next((i for i in range(len(unseen) - 1, -1, -1) if unseen[i][0] == tag), None)
                if last is not None:
                    del unseen[last:]
            elif not (m["attrs"] or "").endswith("/"):
                unseen.append((tag, len(stack)))
        elif tag == "body":
            unseen.clear()
        if tag not in BLOCK_TAGS:
            continue
        while unseen and unseen[-1][0] in BLOCKLESS_TAGS:
            unseen.pop()
        base = unseen[-1][1] if unseen else 1  # what stands below is not of the part that isn't shown
        if m["close"]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
            if not unseen or i is not None and i < base:
                flush()
            if i is not None:
                close(i)
        elif tag != "hr" or not unseen:
            if not unseen:
                flush()
            if tag == "hr":
                continue
            if tag not in ("html", "body") and len(stack) > base and stack[-1].tag in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            if tag in ("li", "tr", "dd", "dt") and len(stack) > base and stack[-1].tag == tag:
                close(len(stack) - 1)
            number += 1
            marks = _named(m["attrs"]) if m["attrs"] and tag not in ("html", "body") else (False, False, False)
            stack.append(Element(tag, number, stack[-1], *marks))
    if not unseen:
        text.append(html[at:])
    flush()
    return out


def logit(block: Block) -> float:
    """Log-odds that the block is content."""
    e, words = block.at, block.text.count(" ") + 1
    links = block.linked / len(block.text)
    z = BIAS + PER_WORD * min(words, LONG) * (1 - links) + LINKS * max(0.0, 2 * links - 1) * (LINKS_INSIDE if e.in_content else 1.0)
    z += IN_CONTENT * e.in_content + CONTENT_NAME * e.named + OUTSIDE * e.outside
    return z + (PARAGRAPH if e.tag in ("p", "blockquote", "pre") else HEADING if re.fullmatch("h[1-6]", e.tag) else 0.0)


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the DOM."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _edge(a: Block, b: Block, distance: int) -> int:
    return math.ceil(SCALE * SMOOTHNESS * (MARKED if a.at.outside != b.at.outside else 1.0) / max(1, distance))


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: source side) of least cost: ``gain`` > 0 is lost where a
    node is labelled False, < 0 where True, and an edge's capacity where its
    ends differ.  Maximum flow by blocking flows on the level graph."""
    n = len(gain)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0)
        elif g < 0:
            add(i, t, -g, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not left[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if left[e] and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(head[a]):
                path.append(head[a][nxt[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                a = to[path.pop() ^ 1]
                nxt[a] += 1


def content(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    gain = [round(SCALE * logit(b)) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, _edge(found[i - 1], b, _distance(found[i - 1].at, b.at))))
        parent = b.at.parent and b.at.parent.number
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, _edge(found[last[parent]], b, 4)))
        last[parent] = i
    return minimum_cut(gain, edges)


def main_text(html: str) -> str:
    found = blocks(html)
    return "\n\n".join(b.text for b, keep in zip(found, content(found)) if keep) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS bigint) AS page_id", "CAST(url AS string) AS url", "CAST(html AS string) AS html").mapInArrow(
        apply, "page_id bigint, url string, text string, n_chars bigint")


@register("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
