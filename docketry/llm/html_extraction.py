"""Main text of web pages by minimum cuts.

A page becomes text blocks in page order. Each has a cost for either label: what
its elements say of it (menus, adverts, the article's own), and what a classifier
makes of its text. Costs are the capacities to the two terminals. Neighbouring
blocks, and blocks under one parent, are tied by edges that weigh less the farther
apart the two lie in the document's tree. The least cut keeps the content.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, fresh, materialize

# Elements inside a line, elements without an end, and elements whose inside is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe noembed noframes xmp".split())
# Elements, words of classes, ids and roles that tell what a part of a page is.
BAD_TAGS = frozenset("head nav footer aside form menu dialog button select textarea option template noscript svg canvas object audio video fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr privacy notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager toolbar masthead header footer copyright comment comments commentlist disqus replies respond widget widgets search complementary contentinfo dialog alert form toc skip".split()
)
GOOD_WORDS = frozenset("article articlebody content entry main post story".split())
NOT_THIS = frozenset("has no with without".split())
#: Start tags that end an open element of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: What elements say, in units of log-odds: of the article, of what is not it, and of blocks outside a page's article.
OF_ARTICLE, OF_OTHER, OUTSIDE = 4.0, -8.0, -4.0
#: The most that a text says; the weight of the edge between blocks under one parent; capacities are whole numbers of 1 / UNITS.
MOST_OF_TEXT, TIE, UNITS = 2.0, 0.6, 1000

SPACE = re.compile("[ \t-\r]+")
_NAME = re.compile(r"/?([a-zA-Z][^ \t-\r/>]*)")
_PLAIN = re.compile("[^\"'>]*")
_TELLING = re.compile(r"(?i)[ \t-\r\"'](class|id|role|itemprop|style|hidden|aria-hidden)(?:[ \t-\r]*=[ \t-\r]*(\"[^\"]*\"|'[^']*'|[^ \t-\r\"'>]+))?")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
FEATURES = 8


class Element:
    """An open or closed element: its parent, depth, and what it and those around it tell."""

    __slots__ = ("name", "parent", "depth", "says", "in_article", "in_form", "home")

    def __init__(self, name: str, parent: Element | None, said: int):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        over = parent.says if parent else 0
        self.in_article = bool(parent and parent.in_article) or said > 0
        # What is set apart from the article stays so, whatever is inside it; but some pages are a form as a whole.
        freed = bool(parent and parent.in_form) and name in GOOD_TAGS and said > 0
        self.says = -1 if over < 0 and not freed else said or over
        self.in_form = over >= 0 and name == "form" or bool(parent and parent.in_form) and said >= 0 and not freed
        # Where a text here belongs: elements inside a line that tell nothing new are passed over.
        self.home = self if parent is None or name not in INLINE or self.says != over else parent.home


def told(name: str, attributes: str, parent: Element | None) -> int:
    """1 where an element is the article or part of it, -1 where it is something else, 0 where it tells nothing."""
    if name in BAD_TAGS or (name == "header" and not (parent and parent.in_article)):
        return -1
    found = 1 if name in GOOD_TAGS else 0
    if not attributes or name in ("html", "body"):
        return found
    for m in _TELLING.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "style":
            if _HIDDEN.search(value):
                return -1
            continue
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return -1
        if key == "aria-hidden":
            continue
        for one in value.split():
            words = _WORDS.findall(_HUMPS.sub(" ", one).lower())
            if NOT_THIS.intersection(words):
                continue
            bad = BAD_WORDS.intersection(words)
            if bad == {"header"} and ((parent and parent.in_article) or GOOD_WORDS.intersection(words)):
                continue
            if bad:
                return -1
            if GOOD_WORDS.intersection(words):
                found = 1
    return found


class Block:
    __slots__ = ("parts", "linked", "element", "text")

    def __init__(self, element: Element):
        self.parts, self.linked, self.element, self.text = [], 0, element, ""


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag that is open at ``at`` ends: behind its ``>``, which quotation marks may hide; a mark that is never closed hides nothing. Pages that end first give their length."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at == len(page):
            return at
        mark = page[at]
        if mark == ">":
            return at + 1
        close = -1 if mark in unclosed else page.find(mark, at + 1)
        if close < 0:
            unclosed.add(mark)
        at = max(at, close) + 1


def blocks_of(page: str) -> list[Block]:
    """A page's blocks with text, in order. Comments, scripts and styles give none."""
    root = Element("", None, 0)
    stack, open_, out, unclosed = [root], {}, [], set()
    block, links, at, size = Block(root), 0, 0, len(page)

    def close() -> None:
        nonlocal block
        if block.parts:
            block.text = SPACE.sub(" ", markup.unescape("".join(block.parts))).strip(" ")
            if block.text:
                out.append(block)
        block = Block(stack[-1].home)

    def pop() -> None:
        nonlocal links
        gone = stack.pop()
        open_[gone.name] -= 1
        links -= gone.name == "a"

    while at < size:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else size]
        if text:
            block.parts.append(text)
            block.linked += len(text) if links else 0
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        named = _NAME.match(page, lt + 1)
        if not named:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                block.parts.append("<")
                at = lt + 1
            continue
        name, ends_tag = named[1].lower(), page[lt + 1] == "/"
        at = tag_end(page, named.end(), unclosed)
        if ends_tag:
            if name == "br" or not open_.get(name):
                block.parts.append(" " if name not in INLINE or name == "br" else "")
                continue
            if name not in INLINE or stack[-1].says != (stack[-1].parent.says if stack[-1].parent else 0):
                close()
            while True:
                gone = stack[-1].name
                pop()
                if gone == name:
                    break
            if not block.parts:
                block = Block(stack[-1].home)
            continue
        if name == "br":
            block.parts.append(" ")
            continue
        attributes = page[named.end() : at]
        if name in RAW:
            raw_end = re.compile(f"</{name}", re.I).search(page, at)
            at = tag_end(page, raw_end.end(), unclosed) if raw_end else size
            continue
        if name not in INLINE:
            # A block ends a paragraph that is open, with all inside it, and some elements end their like.
            leave: str | None = "p" if open_.get("p") else None
            for e in reversed(stack) if name in ENDS and not leave else ():
                if e.name in ENDS[name]:
                    leave = e.name
                if leave or (e.name not in INLINE and e.name != "div"):
                    break
            if leave:
                close()
                while stack[-1].name != leave:
                    pop()
                pop()
        said = told(name, attributes, stack[-1])
        if name not in INLINE or (said and said != stack[-1].says):
            close()
        if name not in VOID and not attributes.endswith("/>"):
            stack.append(Element(name, stack[-1], said))
            open_[name] = open_.get(name, 0) + 1
            links += name == "a"
            if not block.parts:
                block = Block(stack[-1].home)
    close()
    return out


def measures(block: Block) -> list[float]:
    """What a text says, whatever it is in: its size, links, stops, capitals and signs, and whether it is a heading."""
    text = block.text
    words = text.count(" ") + 1
    stops = sum(map(text.count, ".!?"))
    return [
        min(math.log1p(words), 8.0), min(1.0, block.linked / max(1, len(text))), min(1.0, stops * 10 / words), float(text[-1] in ".!?\"'”’"),
        sum(map(str.isupper, text)) / len(text), float(any(c in text for c in "©®|»→")), float(block.element.name[:1] == "h" and block.element.name[1:].isdigit()), min(1.0, len(text) / words / 20),
    ]


def tree_distance(a: Element, b: Element) -> int:
    """Steps in the tree between two elements, 8 at most."""
    steps = 0
    while a is not b and steps < 8:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def own_costs(blocks: list[Block], weights: list[float]) -> list[int]:
    """What a block gains as content, in units: by its elements and, within bounds, by its text. ``weights``: of the measures, and a constant."""
    has_article = any(b.element.in_article for b in blocks)
    out = []
    for b in blocks:
        text = sum(w * m for w, m in zip(weights, measures(b))) + weights[-1]
        said = OF_ARTICLE if b.element.says > 0 else OF_OTHER if b.element.says < 0 else OUTSIDE if has_article and not b.element.in_article else 0.0
        out.append(round(UNITS * (said + max(-MOST_OF_TEXT, min(MOST_OF_TEXT, text)))))
    return out


def ties(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """Edges (earlier, later) -> capacity: from each block to the next one, and to the next one under the same parent."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[Element | None, int] = {}
    for k, b in enumerate(blocks):
        if k:
            edges[k - 1, k] = round(UNITS * TIE / (1 + tree_distance(blocks[k - 1].element, b.element) / 2))
        sibling = last.get(b.element.parent)
        if sibling is not None:
            edges[sibling, k] = edges.get((sibling, k), 0) + round(UNITS * TIE / 2)
        last[b.element.parent] = k
    return edges


def least_cut(gains: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """The labelling (True: content) of least cost: a block costs |gain| if it is labelled against its gain, an edge its capacity if its ends differ. Of equal ones that with the least content.

    A block whose gain outweighs all its edges is labelled at once, and its edges
    become gains of its neighbours. What is left goes to a maximum flow.
    """
    gains, n = list(gains), len(gains)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    weigh = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if label[v] is not None or -weigh[v] < gains[v] <= weigh[v]:
            continue
        label[v] = gains[v] > 0
        for u, w in near[v].items():
            if label[u] is None:
                gains[u] += w if label[v] else -w
                weigh[u] -= w
                queue.append(u)
    left = [v for v in range(n) if label[v] is None]
    if left:
        reached = source_side(left, gains, {v: {u: w for u, w in near[v].items() if label[u] is None} for v in left})
        for v in left:
            label[v] = v in reached
    return [bool(x) for x in label]


def source_side(nodes: list[int], gains: list[int], spare: dict[int, dict[int, int]]) -> set[int]:
    """Nodes that the source reaches after a maximum flow: blocking flows by levels. Positive gains are edges from the source, negative ones to the sink."""
    supply = {v: max(0, gains[v]) for v in nodes}
    demand = {v: max(0, -gains[v]) for v in nodes}
    while True:
        level = {v: 0 for v in nodes if supply[v]}
        order = deque(level)
        found = False
        while order:
            v = order.popleft()
            found = found or demand[v] > 0
            for u, room in spare[v].items():
                if room and u not in level:
                    level[u] = level[v] + 1
                    order.append(u)
        if not found:
            return set(level)
        ways = {v: list(spare[v]) for v in level}
        for start in [v for v in level if supply[v]]:
            path = [start]
            while path and supply[start]:
                v = path[-1]
                if demand[v]:
                    moved = min([supply[start], demand[v], *(spare[a][b] for a, b in zip(path, path[1:]))])
                    supply[start] -= moved
                    demand[v] -= moved
                    for a, b in zip(path, path[1:]):
                        spare[a][b] -= moved
                        spare[b][a] += moved
                    path = [start]
                    continue
                while ways[v] and not (spare[v][ways[v][-1]] and level.get(ways[v][-1]) == level[v] + 1):
                    ways[v].pop()
                if ways[v]:
                    path.append(ways[v][-1])
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def main_text(page: str | None, weights: list[float]) -> str:
    """A page's main text: the content blocks of the least cut, joined by one space."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return " ".join(b.text for b, kept in zip(blocks, least_cut(own_costs(blocks, weights), ties(blocks))) if kept)


def fit_text_weights(pages: DataFrame, html: str = "html", max_pages: int = 4_000) -> list[float]:
    """Weights of ``measures`` and a constant: a logistic regression on blocks of about ``max_pages`` pages whose elements say what they are.

    More pages than that are thinned out by a hash of the page. Where the blocks
    are of one kind only, all weights are 0, and elements alone decide.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    bodies = pages.select(F.col(html).alias("html")).where("html is not null")
    rows = bodies.count()
    if rows > max_pages:
        bodies = bodies.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int((1 << 30) * max_pages / rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                known = [b for b in blocks_of(page) if b.element.says]
                if known:
                    yield pd.DataFrame({"label": [float(b.element.says > 0) for b in known], "measures": [measures(b) for b in known]})

    known = materialize(bodies.mapInPandas(run, "label double, measures array<double>"), "blocks")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        discard(known)
        return [0.0] * (FEATURES + 1)
    # Both kinds weigh the same, however many blocks a page's article has.
    weight = F.when(F.col("label") == 1, 1.0 / counts[1.0]).otherwise(1.0 / counts[0.0]) * sum(counts.values())
    model = LogisticRegression(maxIter=30, regParam=0.01, weightCol="weight").fit(known.select("label", array_to_vector("measures").alias("features"), weight.alias("weight")))
    discard(known)
    return [*map(float, model.coefficients), float(model.intercept)]


def extract_main_text(pages: DataFrame, html: str = "html", weights: list[float] | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of each page, and ``n_chars``, its code points. A null or empty page has an empty text.

    Input columns of these names are replaced; all others, and repeated rows, come
    back as they are; an empty table stays empty. A page is worked on whole, in one
    place; nothing is shuffled. ``weights``: of the texts' measures, learned from the pages if not given.
    """
    weights = fit_text_weights(pages, html) if weights is None else weights

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, weights) for page in batch], dtype=object)

    (found,) = fresh(pages, "_text")
    out = pages.withColumn(found, text_of(F.col(html)))
    columns = [F.col(c) for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return out.select(*columns, F.col(found).alias("text"), F.length(found).cast("long").alias("n_chars"))
