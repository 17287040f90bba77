"""Main text of web pages: block labels by minimum cut.

A page becomes a row of text blocks.  Each block has a cost for either label,
main text or boilerplate, and two kinds of edges ask neighbours to agree: blocks
next to each other on the page, and consecutive blocks of one parent element.
Costs are terminal capacities, edges are smoothness capacities, and the minimum
cut, found by maximum flow, is the cheapest labelling.

Costs come from a logistic classifier over what a block looks like (length, links,
punctuation, and, at a bounded weight, paragraph or heading), trained on the blocks of
at most ``SAMPLE_PAGES`` pages (the documented bound) whose elements tell what they
are, and from what those elements say:

* a boilerplate tag (``footer``) or class name (``cookie-notice``, ``post-footer``) costs
  more than looks and neighbours can pay, so paragraphs in it stay out;
* words that only describe an element (``has-sidebar``), and names and forms around an
  article, say little: looks and neighbours decide;
* an article keeps what is in it, headings, tables and lists included, but for
  boilerplate of its own and lists that are short links and little else.

Inside a block white space becomes one space; blocks are joined by an empty line.
Defined cases: a null page is the empty page, whose text is empty; unclosed
elements end with their parent, a cut-off tag at the end is dropped, and the
content of a script or style that is never closed is not text; pages of any length are
read whole; repeated rows are pages of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import text_struct

SAMPLE_PAGES = 500
TRAINING_STEPS = 300
NEIGHBOUR_WEIGHT = 0.6
PARENT_WEIGHT = 0.9
# log-odds that an element's meaning adds to the classifier's.  Looks are worth at most
# LARGEST_COST, the edges of a block at most twice NEIGHBOUR_WEIGHT + PARENT_WEIGHT: a
# boilerplate element is beyond both, an article beyond looks
LARGEST_COST = 4.0
OTHER_EVIDENCE = 9.0
ARTICLE_EVIDENCE = 6.0
MAIN_EVIDENCE = 2.0
PART_EVIDENCE = 1.5
# a describing name of an element that holds an article or a first heading
HOLDER_EVIDENCE = 0.5
# a list is one of links if so much of it is linked, and its items are short
LIST_LINKED, LIST_ITEM = 0.8, 80
# largest weight of what is known from an element's name alone
ELEMENT_WEIGHT = 1.0
# an edge with less left is full
SMALLEST_ROOM = 1e-9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_RAW = frozenset("script style noscript template textarea title iframe select".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr img br object "
    "math mi mn mo mtext mrow msub msup msubsup mfrac msqrt mroot mover munder "
    "svg g path text tspan".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an open element of the first kind ends before one of the second
_ENDS = {
    "p": None,  # before any block element
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
_MAIN_TAGS = frozenset(["article", "main"])
_OTHER_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
_OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie "
    "cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice "
    "notices pagination pager popup promo promoted related reply respond share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget complementary contentinfo search "
    "discussion".split()
)
_MAIN_WORDS = frozenset("article content entry main post story body".split())
# names that begin so tell of something beside or inside the element
_DESCRIBES = frozenset("has have with without no is sticky fixed show hide hidden layout two three".split())
_NAME = re.compile(r"[a-z]+")


@dataclass
class Element:
    tag: str
    parent: int  # number of the element around it
    names: frozenset[str]  # of class, id and role
    holds_main: bool = False  # an article, main or first heading is in it
    chars: int = 0  # of the blocks right below it and their inline elements
    linked: int = 0
    items: int = 0


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    parent: int  # number of the element around the one that holds it
    tag: str
    element: int
    meaning: float = 0.0  # evidence for main text; below 0 for boilerplate, 0 unknown


def _named(names: frozenset[str], holds_main: bool) -> tuple[float, float]:
    """Evidence of names for main text and for boilerplate."""
    main = other = 0.0
    for name in names:
        words = _NAME.findall(name)
        if not _OTHER_WORDS.isdisjoint(words):
            # a post-footer is a footer; has-sidebar is not a sidebar
            whole = _OTHER_WORDS.issuperset(words)
            kind = words[-1] in _OTHER_WORDS and words[0] not in _DESCRIBES
            part = HOLDER_EVIDENCE if holds_main else PART_EVIDENCE
            other = max(other, OTHER_EVIDENCE if whole or kind and not holds_main else part)
        elif not _MAIN_WORDS.isdisjoint(words):
            main = max(main, MAIN_EVIDENCE if _MAIN_WORDS.issuperset(words) else PART_EVIDENCE)
    return main, other


def _meaning(element: Element, above: float) -> float:
    """Evidence of an element for its content, given that of the one around it.

    Boilerplate holds for all below it.
    """
    if above <= -OTHER_EVIDENCE:
        return above
    tag, holds = element.tag, element.holds_main
    if tag == "form" and holds:
        return above  # the page is in a form
    if tag in _OTHER_TAGS or (tag == "header" and above < ARTICLE_EVIDENCE):
        return -OTHER_EVIDENCE
    main, other = _named(element.names, holds)
    if tag in _MAIN_TAGS:
        if other >= OTHER_EVIDENCE and main < MAIN_EVIDENCE:
            return -OTHER_EVIDENCE
        return ARTICLE_EVIDENCE
    if tag in ("html", "body"):
        return above
    if other >= OTHER_EVIDENCE:
        return -OTHER_EVIDENCE
    if tag in ("ul", "ol") and _link_list(element):
        return -OTHER_EVIDENCE
    if above >= ARTICLE_EVIDENCE:
        return above
    if other > main:
        return min(above, 0.0) - (other - main) if above > -PART_EVIDENCE else above
    return above if above < 0 else max(above, main - other)


def _link_list(element: Element) -> bool:
    """Whether a list is short links and little else."""
    return (
        element.items > 1
        and element.linked >= LIST_LINKED * element.chars
        and element.chars <= LIST_ITEM * element.items
    )


def _judge(elements: list[Element], blocks: list[Block]) -> None:
    """Meanings of blocks, from what is known of the elements around them."""
    for element in reversed(elements):
        if element.parent >= 0 and (element.holds_main or element.tag in ("article", "main", "h1")):
            elements[element.parent].holds_main = True
    for block in blocks:
        at = block.element
        while at > 0 and elements[at].tag not in ("ul", "ol"):
            at = elements[at].parent
        elements[at].chars += len(block.text)
        elements[at].linked += block.linked
        elements[at].items += 1
    meanings: list[float] = []
    for element in elements:
        meanings.append(_meaning(element, meanings[element.parent]) if element.parent >= 0 else 0.0)
    for block in blocks:
        block.meaning = meanings[block.element]


def _names(attributes: str) -> frozenset[str]:
    if not attributes or "=" not in attributes:
        return frozenset()
    values = _ATTRIBUTE.findall(attributes)
    return frozenset(n for v in values for n in v.strip("\"'").lower().split())


def page_blocks(html: str) -> list[Block]:
    blocks: list[Block] = []
    elements = [Element("", -1, frozenset())]
    stack: list[tuple[str, int]] = [("", 0)]  # tag and number of open elements
    parts: list[str] = []
    linked = links = 0
    at, n = 0, len(html)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            holder = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE)
            tag, number = stack[holder]
            parent = stack[max(holder - 1, 0)][1]
            blocks.append(Block(text, min(linked, len(text)), parent, tag, number))
        parts.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[index:])
        del stack[index:]

    while at < n:
        token = _TOKEN.search(html, at)
        upto = token.start() if token else n
        if upto > at:
            piece = unescape(html[at:upto])
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not token:
            break
        at = token.end()
        name = token[2]
        if name is None:
            continue
        tag = name.lower()
        if not token[0].endswith(">"):
            break  # cut off
        if token[1]:  # end tag
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag not in _INLINE:
                close()
            if index and not (
                tag in _INLINE and any(s[0] not in _INLINE for s in stack[index + 1 :])
            ):
                pop_to(index)
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            close()
            for i in range(len(stack) - 1, 0, -1):
                ended = _ENDS.get(stack[i][0], frozenset())
                if ended is None or tag in ended:
                    pop_to(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] not in _ENDS:
                    break
        if tag in _VOID or token[3].endswith("/") and tag not in _INLINE and tag != "p":
            continue
        elements.append(Element(tag, stack[-1][1], _names(token[3])))
        stack.append((tag, len(elements) - 1))
        links += tag == "a"
    close()
    _judge(elements, blocks)
    return blocks


N_FEATURES = 8
# features that are an element's name
ELEMENT_FEATURES = slice(6, 8)


def block_features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        marks = sum(b.text.count(c) for c in ".,;:!?")
        out[i] = (
            1.0,
            math.log1p(len(b.text)) / 5,
            min(1.0, b.linked / len(b.text)),
            math.log1p(words) / 4,
            min(1.0, 5 * marks / words),
            b.text[-1] in ".!?",
            b.tag == "p",
            b.tag in _HEADINGS,
        )
    return out


def train(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by gradient descent; classes weigh the same."""
    weights = np.zeros(N_FEATURES)
    if not len(labels) or labels.min() == labels.max():
        return weights
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(TRAINING_STEPS):
        error = 1 / (1 + np.exp(-features @ weights)) - labels
        weights -= 1.0 * (features.T @ (share * error) / len(labels) + 1e-3 * weights)
        # labels come from elements: what their names alone tell must not decide
        weights[ELEMENT_FEATURES] = np.clip(weights[ELEMENT_FEATURES], -ELEMENT_WEIGHT, ELEMENT_WEIGHT)
    return weights


def _sample(html: str) -> tuple[list[float], list[int]]:
    # names that say little do not teach
    blocks = [b for b in page_blocks(html) if abs(b.meaning) > PART_EVIDENCE]
    return block_features(blocks).ravel().tolist(), [int(b.meaning > 0) for b in blocks]


_SAMPLE = pa.struct([("x", pa.list_(pa.float64())), ("y", pa.list_(pa.int64()))])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from the pages with the smallest hash of their id and url."""
    chosen = pages.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html"))
    rows = (
        chosen.limit(sample_pages)
        .select(text_struct(_sample, _SAMPLE)(F.col("html")).alias("s"))
        .select("s.*")
        .collect()
    )
    x = np.array([v for r in rows for v in r["x"]]).reshape(-1, N_FEATURES)
    return train(x, np.array([v for r in rows for v in r["y"]], dtype=float))


class FlowNetwork:
    """Maximum flow by blocking flows; nodes 0 .. n-1, source n, sink n+1.

    Edge e and its reverse e ^ 1 are neighbours in the lists.  A round augments
    along all shortest paths at once, so a page with tens of thousands of blocks
    takes a few passes over them, not one pass per path.
    """

    def __init__(self, n: int):
        self.n = n
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for start, end, room in ((a, b, forth), (b, a, back)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(room)

    def _levels(self) -> list[int]:
        """Steps from the source through edges with room; -1 if out of reach."""
        level = [-1] * (self.n + 2)
        level[self.n] = 0
        queue = deque([self.n])
        while queue:
            at = queue.popleft()
            for e in self.out[at]:
                if self.room[e] > SMALLEST_ROOM and level[self.to[e]] < 0:
                    level[self.to[e]] = level[at] + 1
                    queue.append(self.to[e])
        return level

    def _block(self, level: list[int]) -> None:
        """Fill all paths that rise by one level a step."""
        to, room, sink = self.to, self.room, self.n + 1
        untried = [iter(edges) for edges in self.out]
        current = [next(edges, None) for edges in untried]
        path: list[int] = []
        at = self.n
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= SMALLEST_ROOM)
                at = to[path[full] ^ 1]
                del path[full:]
            e = current[at]
            while e is not None and not (room[e] > SMALLEST_ROOM and level[to[e]] == level[at] + 1):
                e = next(untried[at], None)
            current[at] = e
            if e is not None:
                path.append(e)
                at = to[e]
            elif path:
                at = to[path.pop() ^ 1]
                current[at] = next(untried[at], None)
            else:
                return

    def source_side(self) -> set[int]:
        """Nodes on the source's side of a minimum cut."""
        while (level := self._levels())[self.n + 1] >= 0:
            self._block(level)
        return {i for i, steps in enumerate(level) if steps >= 0}


def labelled(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """True for the blocks of the main text."""
    n = len(blocks)
    if not n:
        return []
    odds = np.clip(block_features(blocks) @ weights, -LARGEST_COST, LARGEST_COST)
    odds = odds + np.array([b.meaning for b in blocks])
    network = FlowNetwork(n)
    for i, value in enumerate(odds.tolist()):
        # a label's cost beyond the other's; what both cost is paid either way
        if value > 0:
            network.edge(n, i, value)
        elif value < 0:
            network.edge(i, n + 1, -value)
    latest: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            network.edge(i - 1, i, NEIGHBOUR_WEIGHT, NEIGHBOUR_WEIGHT)
        if block.parent in latest:
            network.edge(latest[block.parent], i, PARENT_WEIGHT, PARENT_WEIGHT)
        latest[block.parent] = i
    main = network.source_side()
    return [i in main for i in range(n)]


def main_text(html: str, weights: np.ndarray) -> str:
    blocks = page_blocks(html)
    return "\n\n".join(b.text for b, main in zip(blocks, labelled(blocks, weights)) if main)


_TEXT = pa.struct([("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page and its length."""
    weights = fit(pages)

    def row(html: str) -> tuple[str, int]:
        text = main_text(html, weights)
        return text, len(text)

    out = text_struct(row, _TEXT)
    return pages.select("page_id", "url", out(F.col("html")).alias("t")).select("page_id", "url", "t.*")
