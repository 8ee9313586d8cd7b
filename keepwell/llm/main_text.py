"""Main text of web pages by minimum-cut labelling of their blocks.

A page is a row of text blocks in a tree.  A classifier gives each block the
log-odds of being content, from its own text and from what encloses it; these
costs are the capacities to the two terminals.  Blocks that follow one another
and blocks with one parent are tied by edges, the stronger the closer they are
in the tree.  The minimum cut separates content from boilerplate at the least
sum of costs against the evidence and ties cut.

A block whose evidence outweighs all its ties has its label in every minimum
cut; it is settled first, and its ties become evidence of its neighbours.
Max-flow runs on what stays open.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, per_text, schema_of

#: A comment (to its end or the page's), a tag with its attributes, or a declaration.
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<[!?/][^>]*+>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What these hold is no text of the page; up to the end tag it is not even markup.
RAW = frozenset({"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"})
#: What these hold is left out.
UNSEEN = RAW | {"head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist", "button"}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "embed", "font", "i", "img", "input", "ins", "kbd", "label",
    "mark", "meter", "output", "progress", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
})
#: An open one of these ends where another of its group begins, unless a container stands between.
_SIBLINGS = {**dict.fromkeys(("li",), {"li"}), **dict.fromkeys(("dt", "dd"), {"dt", "dd"}), "tr": {"tr", "td", "th"}, **dict.fromkeys(("td", "th"), {"td", "th"})}
_CONTAINERS = frozenset({"ul", "ol", "dl", "table"})

#: Log-odds of content for what encloses a block.
ENCLOSED = {"article": 3.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "header": -8.0, "fieldset": -8.0}
ROLES = {"navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0, "dialog": -8.0, "alertdialog": -8.0, "alert": -8.0, "menu": -8.0, "menubar": -8.0, "toolbar": -8.0, "main": 3.0, "article": 3.0}
#: Parts of class and id names.
PARTS = {
    **dict.fromkeys(("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "skip"), -6.0),
    **dict.fromkeys(("sidebar", "aside", "widget", "rail", "related", "recommended", "trending"), -6.0),
    **dict.fromkeys(("footer", "colophon", "copyright", "masthead", "header", "topbar"), -6.0),
    **dict.fromkeys(("ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "banner", "promo", "promotion", "sponsor", "sponsored"), -8.0),
    **dict.fromkeys(("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "disclaimer"), -8.0),
    **dict.fromkeys(("comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion"), -8.0),
    **dict.fromkeys(("share", "sharing", "social", "subscribe", "subscription", "newsletter", "signup", "login", "search", "form"), -6.0),
    **dict.fromkeys(("byline", "meta", "tags", "tagcloud", "hidden"), -4.0),
    **dict.fromkeys(("article", "content", "post", "entry", "story", "main", "text"), 1.5),
}
#: Above the innermost article only these still speak against what it holds.
_OUTER = frozenset({"nav", "aside", "footer", "dialog", "menu"})
_OUTER_PARTS = frozenset({"comment", "comments", "commentlist", "replies", "disqus", "related", "recommended", "sidebar", "widget"})
_BESIDE = frozenset({"has", "with", "no", "not", "without"})
_STOCK = re.compile(r"^(?:©|\(c\)|copyright\b)|\b(?:all rights reserved|cookies?|privacy policy|terms of (?:use|service)|sign up|log in|subscribe|advertisement)\b", re.IGNORECASE)
_ENDS = ".!?…:;\"'”’»)"

#: Ties of neighbours with one parent; it falls with the distance of the parents, and where what encloses them speaks otherwise.
ADJACENT = 2.0
#: Ties of a block to the one before it under its parent, where others stand between.
SAME_PARENT = 1.0
#: Costs are whole numbers of this part, so that equal sums are equal.
UNIT = 1000


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    #: Log-odds of what it holds, everything above it included.
    odds: float
    against: float
    hidden: bool


@dataclass(slots=True)
class Block:
    text: str
    parent: Element
    #: Log-odds of what encloses it, and of all there is to it.
    enclosed: float
    odds: float


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _name_parts(names: str) -> set[str]:
    """The parts of class names in lower case, without names that only say what else is there, like has-sidebar."""
    out: set[str] = set()
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[0] not in _BESIDE:
            out.update(parts)
    return out


def _opened(tag: str, raw: str, parent: Element | None) -> Element:
    at = _attributes(raw) if raw else {}
    style = at.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    depth, odds, against = (parent.depth + 1, parent.odds, parent.against) if parent else (0, 0.0, 0.0)
    role = at.get("role", "").lower()
    own = ENCLOSED.get(tag, ROLES.get(role, 0.0))
    inside = odds >= 3.0
    if tag == "header" and inside:
        own = 0.0
    if own > 0:
        # What encloses the article as a whole, like a column or a form, says nothing of it.
        return Element(tag, parent, depth, own + against, against, hidden or (parent is not None and parent.hidden))
    parts = _name_parts(f"{at.get('class', '')} {at.get('id', '')}") if tag not in ("html", "body") else set()
    if inside:
        parts -= {"header", "form"}
    worst = min([own, *(PARTS[p] for p in parts if p in PARTS)])
    best = max([0.0, *(PARTS[p] for p in parts if p in PARTS)])
    # A list of names may hold both kinds; the one against counts.
    change = worst if worst < 0 else best if odds < 1.5 else 0.0
    if change < 0 and (tag in _OUTER or parts & _OUTER_PARTS or inside):
        against = min(against, change - 3.0)
    return Element(tag, parent, depth, odds + change, against, hidden or (parent is not None and parent.hidden))


def evidence(text: str, linked: int, block: Element) -> float:
    """Log-odds that a block is content: what encloses it, its length, its links, its end."""
    out = block.odds + max(-2.0, min(2.5, math.log2((1 + len(text)) / 40))) - 5.0 * min(1.0, linked / len(text))
    heading = len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1].isdigit()
    if block.tag == "p" or heading:
        out += 0.5
    if not heading:
        out += 0.5 if text[-1] in _ENDS else -0.5
    if len(text) < 300 and _STOCK.search(text):
        out -= 2.0 if block.odds > 0 else 3.0
    return out


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in its order, white space made single; hidden and empty ones are left out.

    A block is the text between two starts or ends of elements that are not
    inline; a line break inside it is white space.  Tags that are not closed
    end where their parent or their next sibling begins.
    """
    root = Element("", None, 0, 0.0, 0.0, False)
    out: list[Block] = []
    here, held, linked, links = root, [], 0, 0
    unseen: Element | None = None

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                # The nearest element that is not inline is the block, and its parent ties it to others.
                block = here
                while block.tag in INLINE and block.parent is not None:
                    block = block.parent
                if not block.hidden:
                    out.append(Block(text, block.parent or block, block.odds, evidence(text, linked, block)))
        linked = 0

    def close(to: Element) -> None:
        """Ends ``to`` and what is open inside it."""
        nonlocal here, links, unseen
        flush()
        at = here
        while True:
            links -= at.tag == "a"
            if at is unseen:
                unseen = None
            if at is to:
                break
            at = at.parent
        here = to.parent

    at = 0
    while True:
        found = _MARKUP.search(page, at)
        if unseen is None and (found.start() if found else len(page)) > at:
            text = html.unescape(page[at : found.start() if found else len(page)])
            held.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            to = here
            while to is not root and to.tag != tag:
                to = to.parent
            if to is root:
                continue
            if tag in INLINE:
                # Inside a block only; the end of an inline tag does not end a block.
                inner = here
                while inner is not to and inner.tag in INLINE:
                    inner = inner.parent
                if inner is not to:
                    continue
                at_element = here
                while True:
                    links -= at_element.tag == "a"
                    if at_element is to:
                        break
                    at_element = at_element.parent
                here = to.parent
            else:
                close(to)
            continue
        if tag == "br" or tag in VOID:
            if tag not in INLINE:
                flush()
            else:
                held.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = _SIBLINGS.get(tag, ())
            outer = here
            while outer is not root and (outer.tag in INLINE or outer.tag == "p"):
                outer = outer.parent
            if outer is not here:
                # A paragraph holds no blocks; inline tags left open end with theirs.
                step = here
                while step.parent is not outer:
                    step = step.parent
                if any(x == "p" for x in _tags(here, outer)) or step.tag in INLINE:
                    close(step)
            if ends:
                sibling = here
                while sibling is not root and sibling.tag not in ends and sibling.tag not in _CONTAINERS:
                    sibling = sibling.parent
                while sibling is not root and sibling.tag in ends:
                    close(sibling)
                    sibling = here
                    if tag != "tr":
                        break
        here = _opened(tag, found[3], here)
        links += tag == "a"
        if tag in UNSEEN and unseen is None:
            unseen = here
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def _tags(inner: Element, outer: Element):
    while inner is not outer:
        yield inner.tag
        inner = inner.parent


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): neighbours, and the nearest block before with the same parent."""
    out, last = [], {}
    for j, block in enumerate(blocks):
        if j:
            apart = _distance(blocks[j - 1].parent, block.parent) + abs(blocks[j - 1].enclosed - block.enclosed) / 2
            out.append((j - 1, j, round(UNIT * ADJACENT / (1 + apart))))
        before = last.get(id(block.parent))
        if before is not None and before < j - 1:
            out.append((before, j, round(UNIT * SAME_PARENT / (1 + abs(blocks[before].enclosed - block.enclosed) / 2))))
        last[id(block.parent)] = j
    return out


def minimum_cut(odds: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling with the least sum of odds against it and ties cut; among equals the one with most True.

    odds[i] > 0 is the cost of False, < 0 that of True.
    """
    near: list[list[tuple[int, int]]] = [[] for _ in odds]
    for i, j, capacity in ties:
        near[i].append((j, capacity))
        near[j].append((i, capacity))
    odds = list(odds)
    tied = [sum(c for _, c in x) for x in near]
    label: list[bool | None] = [None] * len(odds)
    ready = deque(range(len(odds)))
    while ready:
        i = ready.popleft()
        if label[i] is None and abs(odds[i]) > tied[i]:
            label[i] = odds[i] > 0
            for j, capacity in near[i]:
                if label[j] is None:
                    odds[j] += capacity if label[i] else -capacity
                    tied[j] -= capacity
                    ready.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        number = {i: k for k, i in enumerate(left)}
        inner = [(number[i], number[j], c) for i, j, c in ties if label[i] is None and label[j] is None]
        for i, content in zip(left, _max_flow([odds[i] for i in left], inner), strict=True):
            label[i] = content
    return label


def _max_flow(odds: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's algorithm; True for what cannot reach the sink in the residual graph."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(i: int, j: int, forth: int, back: int) -> None:
        edges[i].append(len(to))
        edges[j].append(len(to) + 1)
        to.extend((j, i))
        room.extend((forth, back))

    for i, x in enumerate(odds):
        if x > 0:
            tie(source, i, x, 0)
        elif x < 0:
            tie(i, sink, -x, 0)
    for i, j, capacity in ties:
        tie(i, j, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in edges[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        nth = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                # Back to the first edge that is full.
                first = next(k for k, e in enumerate(path) if not room[e])
                i = to[path[first] ^ 1]
                del path[first:]
                continue
            while nth[i] < len(edges[i]):
                e = edges[i][nth[i]]
                if room[e] and level[to[e]] == level[i] + 1:
                    break
                nth[i] += 1
            if nth[i] < len(edges[i]):
                path.append(e)
                i = to[e]
            elif path:
                i = to[path.pop() ^ 1]
                nth[i] += 1
            else:
                break
    reach = {sink}
    queue = deque([sink])
    while queue:
        i = queue.popleft()
        for e in edges[i]:
            if room[e ^ 1] and to[e] not in reach:
                reach.add(to[e])
                queue.append(to[e])
    return [i not in reach for i in range(n)]


def main_text(page: str) -> tuple[str, int, int]:
    """The content blocks joined by line feeds, the number of blocks, and that of content blocks."""
    blocks = blocks_of(page)
    content = minimum_cut([round(UNIT * b.odds) for b in blocks], ties_of(blocks))
    texts = [b.text for b, keep in zip(blocks, content, strict=True) if keep]
    return "\n".join(texts), len(blocks), len(texts)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_blocks, n_content): one row for each row of ``pages``, from its whole html.

    Null and empty pages, and pages without content, have the text ``''``.
    Repeated rows are treated alike, each for itself; an empty table gives no
    rows; a page of any length is taken whole.  All other columns are left
    behind, whatever their names.
    """
    rows = id_and_text(pages, id_col, html_col)
    schema = schema_of(rows, "id", ("text", "string"), ("n_blocks", "long"), ("n_content", "long"))

    def make() -> Callable[[bytes | None], tuple]:
        return lambda page: main_text((page or b"").decode("utf-8", "replace"))

    return per_text(rows, schema, make)


def op13(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars; then n_blocks, n_content."""
    rows = pages.select(F.struct("page_id", "url").alias("page"), "html")
    out = extract(rows, "page", "html")
    return out.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")
