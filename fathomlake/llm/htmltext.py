"""HTML extraction by minimum cut: a classifier prices each text block, neighbours pull each other, max-flow separates them.

No page is labelled, so the classifier of a block's own text is fitted on blocks whose elements say what they are (an article, a
menu), and prices those that stand in plain elements. What elements and names say is a fixed table.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without text of the page, without an end tag, and those that open a new block.
SKIPPED = frozenset("script style template noscript iframe object svg math canvas audio video select datalist textarea title head".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element ends when its start tag comes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "body": set()}
ENDS_P = BLOCK - {"li", "dt", "dd", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "optgroup", "option", "summary", "figcaption"}

#: Log-odds of being content, by the element around and by the names in class, id and role around it.
TAG_COST = {"nav": -6, "footer": -6, "aside": -6, "form": -6, "menu": -5, "button": -6, "label": -3, "dialog": -6, "search": -6, "header": -3, "fieldset": -5, "article": 3.5, "main": 2.5}
NEGATIVE = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-links comment comments consent cookie cookies copyright disclaimer disqus footer foot form header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup popups promo promos promotion related recommended replies reply respond search share sharing sidebar sidebars side sidenav skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert contentinfo complementary dialog discussion reactions reviews tracking gdpr privacy login signup signin"
POSITIVE = "article articlebody content post entry story main maincontent body text hentry page prose"
NAME_COST = {**dict.fromkeys(POSITIVE.split(), 2.0), **dict.fromkeys(NEGATIVE.split(), -6.0)}
#: Words that say little within a name of other words, such as share-price, and those beside which they do, such as share-buttons.
VAGUE = frozenset("share social search tags notice notices alerts form reviews tracking discussion login skip dialog reactions respond reply privacy promotion comment".split())
PARTS = frozenset("area bar block box btn button buttons container count icon icons inner item items link links list panel row section site page top bottom wrap wrapper global media results this policy prompt".split())
VAGUE_COST = -1.5

_TOKEN = re.compile(r"<!--(?:.*?(?:--!?>|\Z)|>)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)(?:\s+|/(?!>)|[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?|\"|'|=)*/?(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def name_cost(value: str) -> float:
    """Log-odds that the names in a class, id or role give: each word once, within the names it stands in."""
    found: dict[str, float] = {}
    for name in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        plain = any(w not in NAME_COST and w not in PARTS for w in words)
        for w in words:
            if w in NAME_COST:
                found[w] = min(found.get(w, math.inf), VAGUE_COST if plain and w in VAGUE else NAME_COST[w])
    return max(-8.0, min(2.0, sum(found.values())))


@dataclass
class Block:
    parts: list[str]
    node: int  # number of the innermost element around, 0 for none
    prior: float  # log-odds of the elements around
    heading: bool = False
    linked: int = 0
    text: str = ""


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, int, float, bool]] = field(default_factory=list)  # name, number, log-odds, hidden
    now: Block | None = None
    links: int = 0
    parents: list[int] = field(default_factory=lambda: [0])  # of each element, by number
    depths: list[int] = field(default_factory=lambda: [0])
    names: dict[str, int] = field(default_factory=dict)  # how many elements of a name are open

    def end_block(self) -> None:
        b, self.now = self.now, None
        if b:
            b.text = " ".join("".join(b.parts).split())
            if b.text:
                self.blocks.append(b)

    def pop_to(self, at: int) -> None:
        for name, *_ in self.open[at:]:
            if name in BLOCK:
                self.end_block()
            self.links -= name == "a"
            self.names[name] -= 1
        del self.open[at:]

    def text(self, raw: str) -> None:
        if self.open and self.open[-1][3]:
            return
        if self.now is None:
            self.now = Block([], *(self.open[-1][1:3] if self.open else (0, 0.0)))
        value = html.unescape(raw) if "&" in raw else raw
        self.now.parts.append(value)
        if not self.now.heading:
            self.now.heading = any(x[0] in HEADINGS for x in self.open[-3:])
        if self.links:
            self.now.linked += len(value.strip())

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS_P and self.names.get("p"):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self.pop_to(at)
                    break
                if self.open[at][0] in BLOCK:
                    break
        if any(map(self.names.get, CLOSES.get(name, ()))):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in SCOPE[name]:
                    break
                if self.open[at][0] in CLOSES[name]:
                    self.pop_to(at)
                    break
        if name in BLOCK:
            self.end_block()
        if name == "br" and self.now:
            self.now.parts.append(" ")
        if name in VOID:
            return
        above = self.open[-1] if self.open else ("", 0, 0.0, False)
        cost, hidden = TAG_COST.get(name, 0.0), above[3] or name in SKIPPED
        if name == "header" and self.names.get("article"):
            cost = 0.0
        for key, *values in _NAMES.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
            key, value = key.lower(), "".join(values)
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
            elif key in ("class", "id", "role") and name not in ("html", "body"):
                cost += name_cost(value)
        self.names[name] = self.names.get(name, 0) + 1
        self.parents.append(above[1])
        self.depths.append(self.depths[above[1]] + 1)
        self.open.append((name, len(self.parents) - 1, max(-12.0, min(5.0, above[2] + cost)), hidden))
        self.links += name == "a"

    def end(self, name: str) -> None:
        if not self.names.get(name):
            if name == "p":
                self.end_block()
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == name:
                self.pop_to(at)
                break
            if name not in BLOCK and self.open[at][0] in BLOCK:
                break  # a stray inline end tag doesn't end the blocks around


@dataclass
class Page:
    """Text blocks in order, and the tree of the elements around them: the parent and depth of each, by number."""

    blocks: list[Block]
    parents: list[int]
    depths: list[int]


def parsed(page: str) -> Page:
    """A page's text blocks: runs of text that no block element interrupts."""
    p, at, n = _Parser(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            p.text(page[at:])
            break
        if m.start() > at:
            p.text(page[at : m.start()])
        token, name, at = m.group(), m.group(1), m.end()
        if name is None:
            continue
        closing, name = token[1] == "/", name.lower()
        if closing:
            p.end(name)
            continue
        p.start(name, token[1 + len(name) : -1])
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = close.start() if close else n
            at = stop
    p.pop_to(0)
    p.end_block()
    return Page(p.blocks, p.parents, p.depths)


#: Weights of the classifier on a block's own text where none can be fitted: bias, log of words, share of linked characters, has an
#: end of sentence, heading.
WEIGHTS = (-1.2, 0.9, -4.0, 0.8, 1.2)
#: Log-odds of the elements around from which on a block is an example, and the least examples of either kind to fit by.
SURE, ENOUGH = 3.0, 200
_SENTENCE = re.compile(r"[.!?…。](?:[\"'”»)\]]*)(?:\s|$)")


def features(b: Block) -> tuple[float, ...]:
    """1, log of words, share of linked characters, has an end of sentence, heading."""
    return 1.0, math.log(b.text.count(" ") + 1), min(1.0, b.linked / max(1, len(b.text))), float(bool(_SENTENCE.search(b.text))), float(b.heading)


def log_odds(b: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """The classifier's log-odds that a block is content, and those of the elements around."""
    own = sum(w * x for w, x in zip(weights, features(b), strict=True))
    return max(-3.0, min(2.5, own)) + b.prior


def examples_of(page: str) -> list[tuple[int, ...]]:
    """For each block whose elements are sure: label, and its features rounded (half logs of words, fifths of linked), so that equal ones can be counted."""
    out = []
    for b in parsed(page).blocks:
        if abs(b.prior) >= SURE:
            _, words, linked, sentence, heading = features(b)
            out.append((int(b.prior > 0), round(2 * words), round(5 * linked), int(sentence), int(heading)))
    return out


def logistic(counts: dict[tuple[int, ...], int], ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of a logistic regression on counted examples, both labels of the same mass; WEIGHTS if a label has too few."""
    rows = np.array([(*k, n) for k, n in sorted(counts.items())], float).reshape(-1, 6)
    y, n = rows[:, 0], rows[:, 5]
    mass = np.array([n[y == 0].sum(), n[y == 1].sum()])
    if mass.min() < ENOUGH:
        return WEIGHTS
    x = np.column_stack([np.ones(len(rows)), rows[:, 1] / 2, rows[:, 2] / 5, rows[:, 3], rows[:, 4]])
    n, w = n / mass[y.astype(int)] / 2, np.zeros(5)
    for _ in range(50):  # Newton's steps on a strictly convex loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(5), x.T @ (n * (y - p)) - ridge * w)
        w = w + step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit_weights(pages: DataFrame, *, html_col: str = "html", max_fit_pages: int = 2000) -> tuple[float, ...]:
    """The classifier's weights, fitted on the blocks of at most max_fit_pages different pages, those of the least hashes. Equal examples are
    counted by the executors; what the driver gets is a few thousand counts, whatever the pages are."""
    hashed = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("x")).where(F.col("x").isNotNull())
    least = hashed.select("h").distinct().orderBy("h").limit(max_fit_pages).agg(F.max("h").alias("h")).first()["h"]
    if least is None:
        return WEIGHTS
    sample = hashed.where(F.col("h") <= least).groupBy("h").agg(F.first("x").alias("x")).select("x")  # copies count once

    def run(batches):
        for batch in batches:
            found = [e for page in batch.column("x").to_pylist() for e in examples_of(page)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int32()) for k in range(5)], names=list("yabcd"))

    counted = sample.mapInArrow(run, "y int, a int, b int, c int, d int").groupBy(*"yabcd").agg(F.count("*").alias("n")).collect()
    return logistic({tuple(r[:5]): r["n"] for r in counted})


def edges_of(page: Page, adjacent: float = 0.3, proximity: float = 0.7) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next, more so the more elements they share; and with the last one under the same parent."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    parents, depths = page.parents, page.depths
    for i, b in enumerate(page.blocks):
        if i:
            x, y, apart = page.blocks[i - 1].node, b.node, 0
            while x != y:  # up to the innermost element around both; over all blocks at most a few steps an element
                if depths[x] >= depths[y]:
                    x = parents[x]
                else:
                    y = parents[y]
                apart += 1
            out.append((i - 1, i, adjacent + proximity * 0.5 ** max(0, apart - 2) if apart <= 6 else adjacent * 0.5))
        parent = parents[b.node]
        if parent and (j := last.get(parent)) is not None and j < i - 1:
            out.append((j, i, proximity * 0.5))
        last[parent] = i
    return out


def max_flow_labels(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost: |cost| for a block labelled against its sign, the weight for a cut edge.

    A block whose cost outweighs all its edges has its label in every least labelling; such blocks are settled first, and what
    they pull their neighbours by is added to those. The rest is a flow network: its minimum cut is found by Dinic's algorithm.
    """
    n = len(costs)
    cost = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                if label[j] is None:
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _min_cut(rest, cost, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _min_cut(rest: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """For each node whether it lies on the source's side of the minimum cut (the source pulls by positive costs)."""
    place = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in rest:
        if cost[i] > 0:
            edge(s, place[i], cost[i], 0.0)
        elif cost[i] < 0:
            edge(place[i], t, -cost[i], 0.0)
        for j, w in near[i].items():
            if j > i:
                edge(place[i], place[j], w, w)
    tiny = 1e-12
    while True:
        depth = [-1] * len(out)
        depth[s], line = 0, [s]
        for u in line:
            for e in out[u]:
                if room[e] > tiny and depth[to[e]] < 0:
                    depth[to[e]] = depth[u] + 1
                    line.append(to[e])
        if depth[t] < 0:
            return [depth[k] >= 0 for k in range(len(rest))]
        turn = [0] * len(out)
        path: list[int] = []
        u = s
        while True:  # blocking flow, without recursion
            if u == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] > tiny and depth[to[e]] == depth[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                u = to[path.pop() ^ 1]
                turn[u] += 1


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The article of a page: its content blocks, joined by line breaks. Empty for a null or empty page."""
    found = parsed(page or "")
    if not found.blocks:
        return ""
    labels = max_flow_labels([log_odds(b, weights) for b in found.blocks], edges_of(found))
    return "\n".join(b.text for b, keep in zip(found.blocks, labels, strict=True) if keep)


def extract_text(pages: DataFrame, *, html_col: str = "html", weights: tuple[float, ...] | None = None, max_fit_pages: int = 2000) -> DataFrame:
    """Every row of pages with text (the article) and n_chars (its code points) instead of the html.

    Without weights the classifier is fitted first, on at most max_fit_pages of the pages (see fit_weights); all pages are extracted.
    A null or empty page gives an empty text. Input columns named text or n_chars are replaced; repeated rows are extracted each; an
    empty table gives an empty result. Pages are read one by one in Arrow batches: nothing is shuffled.
    """
    carried = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    weights = fit_weights(pages, html_col=html_col, max_fit_pages=max_fit_pages) if weights is None else weights
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), "text string", "n_chars long"])

    def extract(batches):
        for x in batches:
            text = [main_text(p, weights) for p in x.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in carried), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*(f.name for f in carried), "text", "n_chars"])

    return pages.select(*[f.name for f in carried], html_col).mapInArrow(extract, schema)
