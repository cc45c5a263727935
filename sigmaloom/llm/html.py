"""Operator 3, HTML extraction: content and boilerplate parted by a minimum cut.

A page is a sequence of text blocks. A linear classifier over a block's own text (length, share of links, end, kind of
element) gives a score; its size is the capacity to the source (content) or the sink (boilerplate). The DOM ties
blocks to what they stand in: an article or main element to the source, menus, footers, forms and elements with
boilerplate names to the sink. Neighbours in page order and neighbours under one ancestor are tied by smoothness
edges. The minimum cut weighs all of them: a short heading or a line that is one link stays in its article,
a long text in a footer goes, an advert between paragraphs goes.

Defined results: null or empty html gives an empty text; so does a page without text blocks; unclosed tags, stray
``<`` and unknown references are taken as browsers take them; repeated rows are judged alike; an empty table
gives no row. Columns are (page_id, url, text, n_chars, n_blocks).

Pages are independent: one pass in Arrow batches, no shuffle; memory is linear in the longest page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[/!?a-zA-Z][^>]*>",
    re.S | re.I,
)
#: Elements that lie inside a line of text; all others end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr object textarea".split())
#: Elements of formulas, which lie inside a line too.
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation".split())
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no article, and names of classes, ids and roles that say so.
OUTSIDE = set("nav header footer aside form button fieldset dialog menu head".split())
OUTSIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side widget menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer foot copyright comment comments disqus reply replies respond share sharing social related recommended subscribe subscription newsletter "
    "popup modal overlay toolbar pagination pager search login signup form contentinfo complementary legal disclaimer".split()
)
#: Of the names, those whose elements hold articles that are not the page's.
FOREIGN_NAMES = set("comment comments disqus reply replies respond related recommended".split())
#: Of the names, those that parts of an article have too; there they weigh less.
WEAK_NAMES = set("banner notice notices header head masthead foot copyright search legal disclaimer form".split())
#: First parts of a class token that say what a layout has, or not.
FORMS = set("has with no without".split())
INSIDE = {"article", "main"}
INSIDE_NAMES = set("article content entry post story main body text".split())
#: Attributes that name an element.
NAMING = {"class", "id", "role"}
#: An attribute of a tag: name and value.
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")

#: Weights of the classifier of a block's text, in units of the cut's capacity.
WEIGHTS = {"bias": -1.0, "named": 1.5, "heading": 0.4, "item": -0.8, "link": -3.0, "words": 0.12, "sentence": 0.8}
#: Ties of the DOM: to an article; to menus and the like, names that say so, what is not shown, names that end so, names that articles have too.
INSIDE_TIE, OUTSIDE_TIE, TOKEN_TIE, HIDDEN_TIE, COMPOUND_TIE, WEAK_TIE = 4.4, 12.0, 10.0, 10.0, 5.0, 2.0
#: Capacity between neighbours: under one parent, and across parents.
NEAR, FAR = 1.0, 0.15


def against(tokens: set[str], names: set[str], inside: bool) -> float:
    """The tie of class tokens to boilerplate: of one that is such a name, else of one that ends in such a name (site-footer), but for has-sidebar and the like."""
    parts = [[x for x in SPLIT.split(t) if x] for t in tokens]
    ends = {p[-1] for p in parts if len(p) > 1 and p[-1] in names and FORMS.isdisjoint(p)}
    whole = tokens & names
    if inside and not (whole | ends) - WEAK_NAMES:
        return WEAK_TIE if whole or ends else 0.0
    return TOKEN_TIE if whole else COMPOUND_TIE if ends else 0.0


def blocks_of(html: str) -> list[tuple[str, float, float, float, int, int]]:
    """(text, score, tie to content, tie to boilerplate, number of the parent element, of its parent) of each text block, in page order."""
    out, stack, parts = [], [], []
    opened: Counter[str] = Counter()
    # of the open elements: (tag, number, state before it); a state is (tie to boilerplate, the part of it that no article resets, inside, named)
    state, number, link, linked = (0.0, 0.0, False, False), 0, 0, 0

    def end_block():
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                n = text.count(" ") + 1
                outside, _, inside, named = state
                tag = stack[-1][0] if stack else ""
                w = WEIGHTS
                score = w["bias"] + w["named"] * named + w["words"] * min(n, 40) + w["link"] * min(1.0, linked / len(text))
                score += w["heading"] * (len(tag) == 2 and tag[0] == "h") + w["item"] * (tag == "li") + w["sentence"] * (text[-1] in ".!?:”\"")
                near, far = (stack[-k][1] if len(stack) >= k else 0 for k in (2, 3))
                out.append((text, score, INSIDE_TIE * inside, outside, near, far))
        linked = 0

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = max(0, link + (-1 if m[2] else 1))
            if tag != "span" or m[2]:
                continue
        else:
            end_block()
        if m[2]:
            while opened[tag]:  # up to and with the last one of that name
                name, _, state = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            continue
        if tag in VOID or tag == "span":
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") or tag[0] == "h" and len(tag) == 2:
            ends = stack and (stack[-1][0] == tag or stack[-1][0] == "p")
        else:
            ends = stack and stack[-1][0] == "p"
        if ends:
            name, _, state = stack.pop()
            opened[name] -= 1
        number += 1
        link = 0 if tag in ("p", "div", "li", "article", "section") else link
        stack.append((tag, number, state))
        opened[tag] += 1
        outside, lasting, inside, named = state
        attrs = m[4]
        tokens, names = set(), set()
        if attrs:
            for found in ATTRIBUTE.finditer(attrs):
                name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
                if name in NAMING:
                    tokens.update(value.lower().split())
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
                    outside = max(outside, HIDDEN_TIE)
            names.update(*(SPLIT.split(t) for t in tokens))
        if tag in INSIDE:
            outside = 0.0
        elif tag == "header" and inside:
            outside = max(outside, WEAK_TIE)  # an article's own head holds its title
        elif tag in OUTSIDE:
            outside = OUTSIDE_TIE
            lasting = outside if tag in ("nav", "aside", "footer") else lasting
        if tag not in INSIDE and tag != "body":
            outside = max(outside, against(tokens, OUTSIDE_NAMES, inside))
            lasting = max(lasting, against(tokens, FOREIGN_NAMES, inside))
        state = (max(outside, lasting), lasting, inside or tag in INSIDE, named or not INSIDE_NAMES.isdisjoint(names))
    if at < len(html):
        parts.append(html[at:])
    end_block()
    return out


def smoothness(near: list[int], far: list[int]) -> list[tuple[int, int, float]]:
    """Edges between blocks next to each other, and between the last two blocks under each block's grandparent."""
    edges, last = [], {}
    for i, key in enumerate(far):
        if i:
            edges.append((i - 1, i, NEAR if near[i] == near[i - 1] else FAR))
        if (j := last.get(key)) is not None and j < i - 1:
            edges.append((j, i, FAR))
        last[key] = i
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source side of a minimum cut (content), given their capacities from the source and to the sink.

    Blocking flows over level graphs: each round sends all it can along the shortest paths, so the few rounds that a
    graph of neighbours needs take time linear in the page.
    """
    n, tiny = len(source), 1e-9
    source, sink = list(source), list(sink)
    for i in range(n):
        both = min(source[i], sink[i])
        source[i] -= both
        sink[i] -= both
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    while True:
        level = {i: 0 for i in range(n) if source[i] > tiny}
        front, reached = list(level), False
        while front and not reached:
            reached = any(sink[i] > tiny for i in front)
            nxt = []
            for i in front if not reached else ():
                for j, c in room[i].items():
                    if c > tiny and j not in level:
                        level[j] = level[i] + 1
                        nxt.append(j)
            front = nxt
        if not reached:
            return [i in level for i in range(n)]
        turn = {i: iter(room[i]) for i in level}
        for start in [i for i in level if level[i] == 0]:
            path = [start]
            while path and source[start] > tiny:
                i = path[-1]
                if sink[i] > tiny:
                    flow = min(source[start], sink[i], *(room[a][b] for a, b in zip(path, path[1:], strict=False)))
                    source[start] -= flow
                    sink[i] -= flow
                    keep = len(path)
                    for k in range(len(path) - 1):
                        a, b = path[k], path[k + 1]
                        room[a][b] -= flow
                        room[b][a] += flow
                        if room[a][b] <= tiny:
                            keep = min(keep, k + 1)
                    # go on from the last block before a full edge
                    path = path[:keep] if sink[i] <= tiny or keep < len(path) else path
                    continue
                for j in turn[i]:
                    if room[i][j] > tiny and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()


def main_text(html: str) -> tuple[str, int]:
    """(text of the content blocks, number of blocks found)."""
    found = blocks_of(html)
    source = [max(0.0, x[1]) + x[2] for x in found]
    sink = [max(0.0, -x[1]) + x[3] for x in found]
    content = minimum_cut(source, sink, smoothness([x[4] for x in found], [x[5] for x in found]))
    return "\n".join(x[0] for x, good in zip(found, content, strict=True) if good), len(found)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            got = [main_text(x or "") for x in batch.column("html").to_pylist()]
            text = pa.array([x for x, _ in got], pa.string())
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": pa.array([len(x) for x, _ in got], pa.int64()), "n_blocks": pa.array([n for _, n in got], pa.int64())})

    d = pages.select("page_id", "url", F.col("html"))
    return d.mapInArrow(run, d.select("page_id", "url").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long"))
