"""HTML extraction by a tree-structured graphical model.

A page becomes a tree of elements.  Every element has a hidden label, content
or not; its own measures (tag, words of its class and id, text, links) give a
potential for each label, and each parent-child edge one for each pair of
labels, the child's kind of tag included.  Sum-product message passing, once
upward and once downward, gives the exact marginal of each element.  The text
blocks of elements that are more likely content than not are the main text.

The potentials are trained from labelled pages: pages whose markup itself
tells the main text by an ``article`` or ``main`` element, at most
``train_pages`` of them, chosen by a hash of their id.  Element potentials are
a logistic model without those two tags in half of the pages, so that pages
without them are understood too; edge potentials are smoothed counts.

Within a content block, character references are decoded, runs of white space
become one space, and the text is trimmed; blocks are joined by two line ends.
Scripts, styles, comments, markup and form controls are never text.

Defined results: a null or empty page, and one without content, gives the
empty text; text outside all blocks is a paragraph like others; broken markup
(unclosed or stray tags) is read as browsers roughly do; repeated pages are extracted alike; without any labelled page the built-in
potentials of ``START`` hold; further columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")

#: Elements without content of their own, and those that begin a block (fixed by the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CONTROLS = frozenset("button select option input textarea label".split())
_ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SELF = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Parts of class and id names that tell what an element is for.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
CONTENT = frozenset("article body content entry main post story text".split())
TAGS = ("article", "main", "p", "h", "div", "section", "li", "ul", "a", "nav", "header", "footer", "aside", "form", "td", "blockquote", "pre", "figure", "other")
_OUT = frozenset("nav header footer aside form button select menu dialog script style".split())
_KIND = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": TAGS.index("h") for i in range(1, 7)} | {"ol": TAGS.index("ul"), "menu": TAGS.index("ul"), "th": TAGS.index("td"), "figcaption": TAGS.index("figure"), "button": TAGS.index("form"), "fieldset": TAGS.index("form"), "dialog": TAGS.index("aside")}
NAMES = (*TAGS, "bad name", "good name", "below bad", "log text", "links", "stops", "short", "bias")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    attributes: str = ""
    parts: list = field(default_factory=list)  # texts, and indexes of child elements
    own: int = 0  # characters of text, of this element and below
    linked: int = 0
    stops: int = 0


def tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, whether it ends an element, tag, attributes, end) of each tag, and at last the text behind them with no tag; in linear time.

    A comment, or a declaration, has no tag.  A quote that nothing closes is an
    ordinary character; a tag that nothing closes takes the rest of the page
    with it, as in browsers.  The consumer may send the place to go on from.
    """
    at = text = 0
    unclosed: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            m, found = None, page.find("-->", at + 4)
            end = found + 3 if found >= 0 else len(page)
        elif page.startswith(("<!", "<?"), at):
            m, found = None, page.find(">", at)
            end = found + 1 if found >= 0 else len(page)
        elif m := _TAG.match(page, at + 1):
            end = m.end()
            while stop := _STOP.search(page, end):
                quote = stop[0]
                end = stop.end()
                if quote == ">":
                    break
                close = -1 if quote in unclosed else page.find(quote, end)
                if close >= 0:
                    end = close + 1
                else:
                    unclosed.add(quote)
            else:
                yield page[text:at], False, "", "", len(page)
                return
        else:
            at += 1
            continue
        moved = yield (page[text:at], bool(m and m[1]), m[2].lower() if m else "", page[m.end() : end - 1] if m else "", end)
        at = text = end if moved is None else moved
    yield page[text:], False, "", "", len(page)


class _Open:
    """The elements that are open at a place of the page, with the depths of those that later tags ask for."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # of all blocks, of those that the page itself has, of implied paragraphs, of controls
        self.firm: list[int] = []
        self.implied: list[int] = []
        self.controls: list[int] = []

    def _lists(self, tag: str) -> list[list[int]]:
        out = [self.depths.setdefault(tag, [])]
        if tag in BLOCK:
            out.append(self.blocks)
        if tag in CONTROLS:
            out.append(self.controls)
        return out

    def push(self, node: int, tag: str, implied: bool = False) -> None:
        depth = len(self.nodes)
        for x in (*self._lists(tag), *([self.implied] if implied else [self.firm] if tag in BLOCK else [])):
            x.append(depth)
        self.nodes.append(node)
        self.tags.append(tag)

    def close(self, depth: int) -> None:
        """Closes everything from ``depth`` on."""
        while len(self.nodes) > depth:
            self.nodes.pop()
            for x in self._lists(self.tags.pop()):
                x.pop()
        for x in (self.firm, self.implied):
            while x and x[-1] >= depth:
                x.pop()

    def last(self, *tags: str) -> int:
        """The depth of the innermost of ``tags``, 0 if none is open."""
        return max((x[-1] for t in tags if (x := self.depths.get(t))), default=0)


def tree(page: str) -> list[Node]:
    """Elements of a page in order, parents before children; the first is the root.

    Text outside all blocks, with the usual inline elements around it, gets a
    paragraph of its own, as if the page had one there.  Takes linear time,
    whatever the page holds.
    """
    nodes, now = [Node("#root", -1)], _Open()

    def add(tag: str, attributes: str = "") -> int:
        nodes.append(Node(tag, now.nodes[-1], attributes))
        nodes[now.nodes[-1]].parts.append(len(nodes) - 1)
        return len(nodes) - 1

    found = tokens(page)
    go_on = None
    while True:
        try:
            text, ends, tag, attributes, end = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if text:
            if text.strip() and not now.blocks and not now.controls:
                now.push(add("p"), "p", implied=True)
            nodes[now.nodes[-1]].parts.append(text)
        if not tag:
            continue
        if ends:
            depth = now.last(tag)
            # An inline end tag doesn't close blocks around it.
            if depth and (tag in BLOCK or not now.firm or now.firm[-1] < depth):
                now.close(depth)
            continue
        if tag in BLOCK or tag == "head":
            if now.implied:
                now.close(now.implied[0])
        elif tag in _INLINE and len(now.nodes) == 1:
            now.push(add("p"), "p", implied=True)
        # A block closes an open paragraph and the inline elements inside it.
        if tag in _ENDS_P and now.blocks and now.tags[now.blocks[-1]] == "p":
            now.close(now.blocks[-1])
        if tag in _SELF:
            closes, until = _SELF[tag]
            depth = now.last(*closes.split())
            if depth > now.last(*until):
                now.close(depth)
        own, closed = add(tag, attributes), attributes.rstrip().endswith("/")
        if tag in _RAW_END and not closed:
            stop = _RAW_END[tag].search(page, end)
            go_on = stop.end() if stop else len(page)
        elif tag not in VOID and not closed:
            now.push(own, tag)
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                n = len(part.strip())
                node.own += n
                node.stops += part.count(". ") + part.count(".") * (n > 0)
            else:
                child = nodes[part]
                node.own += child.own
                node.linked += child.own if child.tag == "a" else child.linked
                node.stops += child.stops
    return nodes


def _names(node: Node) -> tuple[bool, bool]:
    bad = good = False
    for m in _ATTRIBUTE.finditer(node.attributes):
        words = set(_PART.findall((m[1] or m[2] or m[3] or "").lower()))
        bad, good = bad or bool(words & NOT_CONTENT), good or bool(words & CONTENT)
    return (bad and not good) or bool(_HIDDEN.search(node.attributes)), good


def measures(nodes: list[Node], blind: bool = False) -> np.ndarray:
    """A row for each element, in the order of ``NAMES``; ``blind``: without the tags that label pages."""
    out = np.zeros((len(nodes), len(NAMES)))
    n = len(TAGS)
    below = [False] * len(nodes)
    for i, (row, node) in enumerate(zip(out, nodes, strict=True)):
        kind = _KIND.get(node.tag, n - 1)
        row[n - 1 if blind and kind < 2 else kind] = 1
        if node.attributes:
            row[n], row[n + 1] = _names(node)
        row[n + 2] = node.parent >= 0 and below[node.parent]
        below[i] = bool(row[n + 2] or row[n] or node.tag in _OUT)
        row[n + 3] = math.log1p(node.own) / 5
        row[n + 4] = node.linked / node.own if node.own else 0
        row[n + 5] = math.log1p(node.stops) / 3
        row[n + 6] = node.own < 40
        row[n + 7] = 1
    return out


def labels(nodes: list[Node]) -> np.ndarray | None:
    """Whether each element is main text, by a page's own ``article`` or ``main``; None for pages without."""
    named = {"article"} if any(x.tag == "article" for x in nodes) else {"main"}
    if not any(x.tag in named for x in nodes):
        return None
    inside = np.zeros(len(nodes), bool)
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        out[i] = (node.parent >= 0 and out[node.parent]) or node.tag in _OUT or (bool(node.attributes) and _names(node)[0])
        inside[i] = not out[i] and (node.tag in named or (node.parent >= 0 and inside[node.parent]))
    return inside


@dataclass
class Model:
    """Weights of the measures, and log potentials of edges by the child's kind of tag, parent's and child's label."""

    weights: np.ndarray
    edges: np.ndarray


def _start() -> Model:
    own = {"article": 3, "main": 3, "p": 3, "h": 1.5, "nav": -6, "header": -4, "footer": -6, "aside": -5, "form": -5, "bad name": -5, "good name": 1, "below bad": -8, "log text": 2, "links": -4, "stops": 0.5, "short": -1, "bias": 0}
    edges = np.full((len(TAGS), 2, 2), math.log(0.1))
    edges[:, 0, 0] = edges[:, 1, 1] = math.log(0.9)
    edges[:2, 0] = np.log([0.05, 0.95])
    edges[[TAGS.index(t) for t in ("p", "h")], 1] = np.log([0.03, 0.97])
    for tag in ("nav", "header", "footer", "aside", "form"):
        edges[TAGS.index(tag), :, 1] = math.log(0.01)
    return Model(np.array([own.get(x, 0.0) for x in NAMES]), edges)


START = _start()


def marginals(nodes: list[Node], model: Model) -> np.ndarray:
    """The chance that each element is content: messages from the leaves up, then from the root down."""
    score = measures(nodes) @ model.weights
    kinds = [_KIND.get(x.tag, len(TAGS) - 1) for x in nodes]
    pair = np.exp(model.edges).tolist()
    up = [[1.0, math.exp(max(-30.0, min(30.0, s)))] for s in score.tolist()]
    sent: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        a, b = up[i]
        (p00, p01), (p10, p11) = pair[kinds[i]]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
        total = m0 + m1
        sent[i] = (m0 / total, m1 / total)
        above = up[nodes[i].parent]
        above[0] *= sent[i][0]
        above[1] *= sent[i][1]
        total = above[0] + above[1]
        above[0] /= total
        above[1] /= total
    belief = up
    for i in range(1, len(nodes)):
        a, b = belief[nodes[i].parent]
        a, b = a / max(sent[i][0], 1e-300), b / max(sent[i][1], 1e-300)  # the parent's belief without this child
        (p00, p01), (p10, p11) = pair[kinds[i]]
        m0, m1 = a * p00 + b * p10, a * p01 + b * p11
        own = belief[i]
        own[0] *= m0
        own[1] *= m1
        total = own[0] + own[1]
        own[0] /= total
        own[1] /= total
    return np.array([b for _, b in belief])


def _clean(raw: str) -> str:
    return _BLANK.sub(" ", html.unescape(raw)).strip()


def blocks(nodes: list[Node], content: np.ndarray) -> list[str]:
    """The texts of content blocks in page order; inline elements belong to the block around them."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        found = _clean("".join(run))
        run.clear()
        if found:
            out.append(found)

    # (element, next part, whether its text counts)
    stack = [(0, 0, False)]
    while stack:
        i, k, counts = stack.pop()
        node = nodes[i]
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, str):
                if counts:
                    run.append(part)
                continue
            child = nodes[part]
            if child.tag in _RAW_END or child.tag in CONTROLS:
                continue
            if child.tag == "br" or child.tag == "hr":
                run.append("\n")
                continue
            block = child.tag in BLOCK
            if block:
                end()
            stack.append((i, k, counts))
            stack.append((part, 0, bool(content[part]) if block else counts and not _names(child)[0]))
            break
        else:
            if node.tag in BLOCK:
                end()
    end()
    return out


def text_of(page: str | None, model: Model) -> str:
    if not page or not page.strip():
        return ""
    nodes = tree(page)
    return "\n\n".join(blocks(nodes, marginals(nodes, model) > 0.5))


def fit(pages: DataFrame, train_pages: int = 2000, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Potentials from at most ``train_pages`` pages that label themselves.

    Tasks send only sums: counts of elements with equal measures and of edges,
    so what reaches the driver is bounded by the pages' number.
    """
    chosen = pages.filter(F.col(html_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("_id")).distinct().orderBy("h", "_id").limit(train_pages)
    train = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("html")).join(F.broadcast(chosen), "_id").select("h", "html")
    kinds = len(TAGS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, edges = [], np.zeros(kinds * 4)
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes = tree(page.as_py())
                label = labels(nodes)
                if label is None:
                    continue
                x = measures(nodes, blind=h % 2 == 0)
                rows.append(np.column_stack([x, label]))
                for node, own in zip(nodes[1:], label[1:], strict=True):
                    edges[_KIND.get(node.tag, kinds - 1) * 4 + 2 * int(label[node.parent]) + int(own)] += 1
            # Elements alike in measures (to a tenth) count together.
            found, times = np.unique(np.round(np.vstack(rows), 1), axis=0, return_counts=True) if rows else (np.zeros((0, len(NAMES) + 1)), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array([found.astype("<f8").tobytes()]), pa.array([times.astype("<f8").tobytes()]), pa.array([edges.astype("<f8").tobytes()])], ["x", "n", "edges"])

    got = train.mapInArrow(sums, "x binary, n binary, edges binary").collect()
    x = np.vstack([np.zeros((0, len(NAMES) + 1)), *[np.frombuffer(r.x, "<f8").reshape(-1, len(NAMES) + 1) for r in got]])
    times = np.concatenate([np.zeros(0), *[np.frombuffer(r.n, "<f8") for r in got]])
    if not len(x) or x[:, -1].min() == x[:, -1].max():
        return START
    counts = sum(np.frombuffer(r.edges, "<f8") for r in got).reshape(kinds, 2, 2)
    prior = 8 * np.exp(START.edges)
    edges = np.log((counts + prior) / (counts + prior).sum(2, keepdims=True))
    y, x = x[:, -1], x[:, :-1]
    # Penalised towards START, so what the pages don't show keeps its meaning; each element counts little, as its neighbours tell the same.
    w, ridge, times = START.weights.copy(), 2.0, times / max(1.0, times.sum() / 2000)

    def loss(w: np.ndarray) -> float:
        return float((times * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + ridge / 2 * ((w - START.weights) ** 2).sum())

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hess = (x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, x.T @ (times * (y - p)) - ridge * (w - START.weights)), 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return Model(w, edges)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
