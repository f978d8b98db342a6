"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block node gets the probability that it belongs to the main text. The decoding chooses the most likely
labelling in which nothing below a rejected node is kept. The trees are fitted in numpy on pages that a
seeded generator writes together with their labels.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.llm import textkit as tk

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)", re.S)
#: What ends a tag, or opens a value in which ``>`` doesn't end it.
TAG_PART = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-label|itemprop)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text and holds no tags.
RAW = frozenset("script style textarea template title".split())
#: Roots of foreign content, where a self-closed tag is empty, and its parts that hold HTML again.
FOREIGN, HTML_AGAIN = frozenset(("svg", "math")), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Tags that end foreign content left open.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
TAGS = "p div article main section header footer nav aside form ul ol li h1 h2 h3 table td blockquote pre figure dl body".split()
#: Words of class, id and role that tell a node's part.
ROLES = "nav menu navbar header masthead topbar banner footer copyright legal sidebar aside widget rail ad ads advert sponsor promo cookie consent notice alert popup modal newsletter subscribe signup comment comments reply discussion respond related recommended share social breadcrumb breadcrumbs pagination pager login search form toolbar tags meta author byline content article post entry main story body text page wrapper container hero lead".split()
_ROLE = {w: k for k, w in enumerate(ROLES)}
N_SHAPE = 22
N_FEATURES = N_SHAPE + len(TAGS) + 2 * len(ROLES)


class Node:
    __slots__ = ("children", "depth", "label", "own", "parent", "roles", "start", "tag", "texts")

    def __init__(self, tag: str, parent: int, depth: int, roles: list[int]):
        self.tag, self.parent, self.depth, self.roles = tag, parent, depth, roles
        self.children: list[int] = []
        self.own, self.start = [0, 0, 0, 0], 0  # characters, characters in links, tags, marks


class TagEnds:
    """Where tags end, in time linear in the page: a quoted value that is never closed, or a tag that never ends,
    makes quotes of this page mean nothing from there on, so a tag ends at the next ``>``."""

    def __init__(self, source: str):
        self.source, self.broken = source, False

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; the page's size if none does."""
        k = at
        while not self.broken:
            m = TAG_PART.search(self.source, k)
            if m and m[0] == ">":
                return m.start()
            close = self.source.find(m[0][-1], m.end()) if m else -1
            self.broken = close < 0
            k = close + 1
        end = self.source.find(">", at)
        return end if end >= 0 else len(self.source)


def dom(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes in page order, texts with their node). Inline elements belong to the block around them."""
    nodes = [Node("html", -1, 0, [])]
    stack: list[tuple[str, int]] = [("html", 0)]
    texts: list[tuple[int, str]] = []
    at, link, size = 0, 0, len(source)
    new_block, embedded, ends = True, False, TagEnds(source)

    def text(part: str) -> None:
        nonlocal new_block
        node = stack[-1][1]
        value = html.unescape(part)
        bare = value.strip()
        if bare:
            own = nodes[node].own
            own[0] += len(bare)
            own[3] += sum(bare.count(c) for c in ".,;:!?")
            if link:
                own[1] += len(bare)
        if new_block or not texts:
            texts.append((node, value))
            new_block = False
        else:
            texts[-1] = (texts[-1][0], texts[-1][1] + value)

    def pop_to(k: int) -> None:
        nonlocal link, new_block
        for tag, _ in stack[k:]:
            if tag == "a":
                link -= 1
            if tag not in INLINE:
                new_block = True
        del stack[k:]

    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        end = ends.after(at)
        inner, at = source[at:end], end + 1
        tag = m[1].lower()
        if source[m.start() + 1] == "/":
            k = len(stack) - 1
            while k > 0 and stack[k][0] != tag:
                if tag in INLINE and stack[k][0] not in INLINE:
                    k = 0
                else:
                    k -= 1
            if k > 0:
                pop_to(k)
            continue
        foreign = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in FOREIGN or stack[k][0] in HTML_AGAIN), 0) if embedded else 0
        if foreign and stack[foreign][0] in FOREIGN and tag in BREAKS_OUT:
            pop_to(foreign)
            foreign = 0
        if inner.endswith("/") and (tag in FOREIGN or (foreign and stack[foreign][0] in FOREIGN)):
            continue
        embedded = embedded or tag in FOREIGN
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE or tag in VOID:
            nodes[stack[-1][1]].own[2] += 1
            if tag == "hr":
                new_block = True
            if tag not in VOID:
                stack.append((tag, stack[-1][1]))
                link += tag == "a"
            continue
        closes, scope = SIBLINGS.get(tag, set()), SCOPE.get(tag, set())
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if name in scope:
                break
            if name in closes or (name == "p" and tag in CLOSES_P):
                pop_to(k)
                break
            if name not in INLINE and not closes and name != "p":
                break
        roles = []
        for a in ATTRIBUTE.finditer(inner) if inner else ():
            if a[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
                for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", a[2] or a[3] or a[4] or ""):
                    if (r := _ROLE.get(word.lower())) is not None:
                        roles.append(r)
        parent = stack[-1][1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, roles))
        nodes[parent].children.append(len(nodes) - 1)
        nodes[-1].start = len(texts)
        stack.append((tag, len(nodes) - 1))
        new_block = True
    return nodes, texts


def features(nodes: list[Node], total_texts: int) -> np.ndarray:
    """Shape of each node's subtree and surroundings, its tag, and the roles of itself and its ancestors."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    parent = np.array([d.parent for d in nodes])
    own = np.array([d.own for d in nodes], np.float32).reshape(n, 4)
    tree, blocks = own.copy(), np.ones(n, np.float32)
    paragraphs = np.array([d.tag == "p" for d in nodes], np.float32)
    headings = np.array([d.tag in ("h1", "h2", "h3") for d in nodes], np.float32)
    items = np.array([d.tag in ("li", "td") for d in nodes], np.float32)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        tree[p] += tree[k]
        blocks[p] += blocks[k]
        paragraphs[p] += paragraphs[k]
        headings[p] += headings[k]
        items[p] += items[k]
    chars = np.maximum(tree[:, 0], 1)
    whole = max(1.0, float(tree[0, 0]))
    siblings = np.array([len(nodes[p].children) if p >= 0 else 1 for p in parent])
    rank = np.zeros(n)
    for d in nodes:
        for i, c in enumerate(d.children):
            rank[c] = i
    up = np.maximum(parent, 0)
    article = np.array([d.tag in ("article", "main") for d in nodes], np.float32)
    for k in range(1, n):
        article[k] = max(article[k], article[parent[k]])
    shape = (
        np.log1p(tree[:, 0]), np.log1p(own[:, 0]), tree[:, 1] / chars, tree[:, 3] / chars * 10, np.log1p(blocks), chars / blocks / 100, tree[:, 0] / whole,
        paragraphs / blocks, headings / blocks, items / blocks, np.array([d.depth for d in nodes]), rank, siblings, rank / np.maximum(1, siblings),
        np.array([d.start for d in nodes]) / max(1, total_texts), tree[up, 0] / whole, tree[:, 0] / np.maximum(1, tree[up, 0]), tree[up, 1] / np.maximum(1, tree[up, 0]), np.log1p(paragraphs[up]), tree[:, 2] / chars * 10,
        article, np.full(n, article.max()),
    )
    x[:, :N_SHAPE] = np.column_stack(shape)
    for k, d in enumerate(nodes):
        if d.tag in TAGS:
            x[k, N_SHAPE + TAGS.index(d.tag)] = 1
        base = N_SHAPE + len(TAGS)
        for r in d.roles:
            x[k, base + r] = 1
        if k:
            above = base + len(ROLES)
            x[k, above:] = np.maximum(x[parent[k], above:], x[parent[k], base:above])
    return x


class Trees:
    """Gradient boosting for a binary label: complete trees of fixed depth on binned features."""

    def __init__(self, count: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24):
        self.count, self.depth, self.rate, self.bins = count, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)])
        used = np.flatnonzero(binned.max(axis=0) > 0)
        binned = binned[:, used]
        n, width, b = len(y), len(used), self.bins
        score = np.full(n, 0.0)
        self.feature, self.cut, self.leaf = [], [], []
        offset = np.arange(width) * b
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, cut = [], []
            for level in range(self.depth):
                cells = 1 << level
                key = (at[:, None] * (width * b) + offset + binned).ravel()
                gs = np.bincount(key, np.repeat(g, width), cells * width * b).reshape(cells, width, b).cumsum(axis=2)
                hs = np.bincount(key, np.repeat(h, width), cells * width * b).reshape(cells, width, b).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                best = gain[:, :, :-1].reshape(cells, -1).argmax(axis=1)
                f, c = best // (b - 1), best % (b - 1)
                feature.append(used[f])
                cut.append(np.array([self.edges[i][min(k, len(self.edges[i]) - 1)] if len(self.edges[i]) else np.inf for i, k in zip(used[f], c, strict=True)]))
                at = at * 2 + (binned[np.arange(n), f[at]] > c[at])
            leaf = np.bincount(at, g, 1 << self.depth) / (np.bincount(at, h, 1 << self.depth) + 1) * self.rate
            score += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut, strict=True):
                at = at * 2 + (x[rows, f[at]] > c[at])
            score += leaf[at]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely labels in which every node below a rejected one is rejected; html and body are kept."""
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    for k in range(len(nodes) - 1, -1, -1):
        for c in nodes[k].children:
            keep[k] += max(keep[c], drop[c])
            drop[k] += drop[c]
    kept = np.zeros(len(nodes), bool)
    for k, d in enumerate(nodes):
        kept[k] = d.tag in ("html", "body") or (kept[d.parent] and keep[k] > drop[k])
    return kept


def choose(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The labels of a page. A form is never main text, unless it holds half of the page's. On a page where
    nothing with text would be kept, the likeliest article or main element (without any: the likeliest block) is,
    with what is about as likely below it."""
    chars = np.array([n.own[0] for n in nodes], np.int64)
    for k in range(len(nodes) - 1, 0, -1):
        chars[nodes[k].parent] += chars[k]
    odds = odds.copy()
    barred = np.zeros(len(nodes), bool)
    for k, d in enumerate(nodes):
        barred[k] = (d.parent >= 0 and barred[d.parent]) or (d.tag == "form" and 2 * chars[k] < chars[0])
    odds[barred] = -1e6
    chars_barred = np.array([n.own[0] * barred[k] for k, n in enumerate(nodes)], np.int64)
    for k in range(len(nodes) - 1, 0, -1):
        chars_barred[nodes[k].parent] += chars_barred[k]
    kept = decode(nodes, odds)
    if chars[0] and not any(kept[k] and d.own[0] for k, d in enumerate(nodes)):
        able = [k for k, d in enumerate(nodes) if chars[k] > chars_barred[k] and not barred[k] and d.tag not in ("html", "head", "body")]
        able = [k for k in able if nodes[k].tag in ("article", "main")] or able
        if able:
            best = max(able, key=lambda k: (odds[k], -k))
            inside = np.zeros(len(nodes), bool)
            inside[best] = True
            for k in range(best + 1, len(nodes)):
                inside[k] = inside[nodes[k].parent] and not barred[k]
            held = max(odds[k] for k, d in enumerate(nodes) if inside[k] and d.own[0])
            raised = np.where(barred, odds, odds + max(0.0, 1 - held))
            up = best
            while up > 0:
                raised[up] = 1e6
                up = nodes[up].parent
            own = decode(nodes, raised)
            for k in range(1, len(nodes)):  # only what is below the chosen block, and the way to it
                kept[k] = raised[k] == 1e6 or (own[k] and inside[k])
    return kept


def main_text(source: str, trees: Trees) -> str:
    return extract_all([source], trees)[0]


def extract_all(pages: list[str], trees: Trees) -> list[str]:
    parsed = [dom(p) for p in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.concatenate([features(n, len(t)) for n, t in parsed]))
    out, done = [], 0
    for nodes, texts in parsed:
        kept = choose(nodes, odds[done : done + len(nodes)])
        done += len(nodes)
        parts = (" ".join(value.split()) for node, value in texts if kept[node] and nodes[node].tag not in ("html", "head", "body"))
        loose = (nodes[0].own[0] + sum(n.own[0] for n in nodes if n.tag == "body")) * 2 > sum(n.own[0] for n in nodes)
        if loose:  # a page whose text stands outside of any block
            parts = (" ".join(value.split()) for node, value in texts if kept[node] and nodes[node].tag != "head")
        out.append(" ".join(p for p in parts if p))
    return out


# ---- pages with labels ----

WORDS = "the of and to in is that for on with as was it by be this are from or an at which report market city people water house study group year power field light music river stone winter summer letter number voice paper road north green".split()


class Writer:
    """Writes random pages; a node with attribute data-x="0" and all below it is no main text."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(WORDS, int(self.r.integers(low, high))))

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.pick(".", ".", ",", "!", "?") for _ in range(int(self.r.integers(low, high))))

    def box(self, semantic: tuple, names: tuple, body: str, main: bool = False) -> str:
        tag = self.pick(*semantic, "div", "section") if not main else self.pick(*semantic)
        name = self.pick(*names)
        attribute = self.pick("class", "id", "class") if name else ""
        shown = f' {attribute}="{name}"' if name and (tag in ("div", "section") or self.r.random() < 0.5) else ""
        return f'<{tag}{shown}{"" if main else " data-x=0"}>{body}</{tag}>'

    def links(self, low: int, high: int) -> str:
        each = [f'<a href="/{self.words(1, 2)}">{self.words(1, 4)}</a>' for _ in range(int(self.r.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.r.random() < 0.7 else " | ".join(each)

    def aside(self) -> str:
        return self.pick(
            lambda: self.box(("aside",), ("sidebar", "widget", "right-rail"), f"<h3>{self.words(1, 3)}</h3>" + self.links(3, 9) + self.pick("", f"<p>{self.prose(1, 3)}</p>")),
            lambda: self.box((), ("ad", "ads", "advert", "sponsor-box", "promo"), self.pick(self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>")),
            lambda: self.box((), ("newsletter", "subscribe", "signup"), f"<p>{self.prose(1, 2)}</p>" + self.form()),
            lambda: self.box(("nav", "aside"), ("related", "recommended", "related-posts"), f"<h3>{self.words(1, 4)}</h3>" + self.links(3, 7)),
            lambda: self.box((), ("share", "social", "social-share"), self.links(2, 5)),
        )()

    def form(self) -> str:
        return f'<form data-x=0><label>{self.words(1, 3)}</label><input type="text"><button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        one = lambda: self.box(("article", "li"), ("comment", "reply"), f"<b>{self.words(1, 3)}</b><p>{self.prose(1, 4)}</p>")
        return self.box(("section",), ("comments", "discussion", "respond"), f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(int(self.r.integers(1, 6)))))

    def article(self) -> str:
        parts = []
        if self.r.random() < 0.15:  # a note of a line or two, its bold text left open
            parts.append(self.pick(f"<p><b>{self.words(1, 6)}<br>", f"<p>{self.words(1, 6).capitalize()}.</p>", f"<p><b>{self.words(1, 6)}<br><p>{self.prose(1, 2)}</p>"))
        for _ in range(0 if parts else int(self.r.integers(1, 12))):
            kind = self.r.random()
            if kind < 0.68:
                parts.append(self.pick(f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p>", f"<p><b>{self.words(2, 8)}</b> {self.prose()}", f'<p>{self.prose(1, 3)} <a href="/x">{self.words(1, 3)}</a> {self.prose(1, 3)}</p>', f"<p>{self.words(1, 3).capitalize()}.</p>"))
            elif kind < 0.78:
                parts.append(f"<h2>{self.words(2, 7)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 14)}</li>" for _ in range(int(self.r.integers(2, 6)))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif kind < 0.91:
                parts.append("<table><tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.93:
                parts.append(f"<pre>{self.words(4, 15)}</pre>")
            else:
                parts.append(self.pick(self.aside, self.aside, self.form)())
        title = self.pick(f"<h1>{self.words(3, 12)}</h1>", f"<header><h1>{self.words(3, 12)}</h1></header>", "")
        return self.box(("article", "main", "div", "section"), ("content", "post-content", "entry-content", "article-body", "story", "main", "text", ""), title + "".join(parts) + self.pick("", "", self.comments()), main=True)

    def page(self) -> str:
        top = self.pick(self.box(("nav",), ("nav", "menu", "navbar", "breadcrumb"), self.links(3, 9)), self.box(("header",), ("header", "masthead", "topbar", "banner"), self.words(1, 4) + self.links(3, 8)))
        notice = self.pick("", "", self.box((), ("cookie-notice", "consent", "alert", "popup", "notice"), f"<p>{self.prose(1, 3)}</p>"))
        before = "".join(self.pick("", self.aside()) for _ in range(2))
        main = self.article()
        if self.r.random() < 0.4:
            main = self.box(("div", "main"), ("wrapper", "container", "page", "content", ""), main + self.pick("", self.aside()), main=True)
        after = "".join(self.pick("", self.aside(), self.comments(), self.form()) for _ in range(2))
        foot = self.box(("footer",), ("footer", "legal", "copyright"), self.pick("&copy; ", "") + self.words(2, 12) + self.pick("", self.links(2, 6), f"<p>{self.prose(1, 2)}</p>"))
        return f"<html><head><title>x</title></head><body>{top}{notice}{before}{main}{after}{foot}</body></html>"


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a written page."""
    marks = iter(re.findall(r"<([a-z][a-z0-9]*)([^>]*)>", source))
    nodes, texts = dom(source.replace(" data-x=0", ""))
    label = np.ones(len(nodes))
    k = 0
    for tag, rest in marks:
        if tag in INLINE or tag in VOID or tag in RAW or tag == "button" and False:
            continue
        k += 1
        if k < len(nodes):
            label[k] = "data-x=0" not in rest
    for k in range(1, len(nodes)):
        label[k] = label[k] and label[nodes[k].parent]
    return features(nodes, len(texts)), label


def train(pages: int = 700, seed: int = 41) -> Trees:
    """Trees from generated pages."""
    writer = Writer(seed)
    both = [labelled(writer.page()) for _ in range(pages)]
    return Trees().fit(np.concatenate([x for x, _ in both]), np.concatenate([y for _, y in both]))


def _extractor(shared, column: str, schema: pa.Schema):
    def run(batches):
        trees = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                text = extract_all([s or "" for s in part.column(at).to_pylist()], trees)
                kept = [part.column(k) for k in range(part.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=schema)

    return run


def extract(pages: DataFrame, *, column: str = "html", trees: Trees | None = None) -> DataFrame:
    """The other columns of ``pages`` with text and n_chars, which replace columns of those names.

    Null html is empty and gives an empty text; an empty table gives no rows; text outside of any block counts only on pages that hold most
    of their text so; repeated rows give a row each."""
    spark = pages.sparkSession
    source = pages.drop(*(n for n in ("text", "n_chars") if n != column))
    ddl = f"{tk.ddl(source.drop(column))}, text string, n_chars long".lstrip(", ")
    return source.mapInArrow(_extractor(spark.sparkContext.broadcast(trees or train()), column, tk.arrow_schema(ddl)), ddl)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html")))
