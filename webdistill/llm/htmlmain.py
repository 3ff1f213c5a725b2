"""Operator 10, HTML extraction by minimum-cut labelling.

A page becomes a sequence of text blocks.  A logistic classifier over what a block looks like (length,
links, stops, tag) and what its containers are called (article, menu, advert, ...) gives the log-odds of
either label.  They are the terminal capacities.  Neighbours in page order and neighbours in one container are
joined by edges that charge for different labels; an edge is weaker the farther apart its blocks stand in
the tree and where a container begins or ends that is called something else.  The minimum cut is the
cheapest labelling; the blocks on the source side are the main text.  A block whose own cost exceeds all
its edges together takes its label before the flow, which leaves the same cut.

Nothing but scripts, styles and hidden elements is settled by its name: an advert's name weighs about as
much as the strongest text does, a layout's name or that of a main column about half.  Where no element is
called main, a container that holds most of the running text of the page is nobody's advert or form, and
its name weighs nothing.

The weights of the text features are fitted here, on the blocks of about ``sample`` pages (picked by a hash of
page_id; pages of more than ``sample_chars`` characters are left out, and of one page the first
``sample_blocks`` blocks are taken), labelled by their containers; with too few blocks of either label
fixed weights stand in.  All pages are extracted, row by row, without shuffle.

Defined cases: null or empty html gives empty text; markup without text likewise.  Repeated rows are
extracted alike; an empty table gives no rows.  Tags without an end, quotes that never close and deep
nesting are read in linear time.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, tidy

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: The rest of a tag; quotes matter after an equals sign only, and only where they close.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_NUMBER = re.compile(r"&#[0-9]{8,};?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLASS_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Dropped with everything inside, up to their end tag.
OPAQUE = frozenset("script style noscript template iframe svg canvas select textarea title audio video".split())
#: Without an end tag these reach to the end of the page; other opaque ones to their container's end or the next block.
RAW = frozenset("script style iframe textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
MAIN = frozenset("article main".split())
BOILER = frozenset("nav footer aside form button dialog menu head fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "subscription signup login comment comments disqus respond reply replies related recommended recommendations pagination pager".split()
)
#: What layouts call containers of text as well.
LAYOUT_WORDS = frozenset("banner header masthead overlay share sharing social widget toolbar hidden search skip".split())
#: These hold even where an article stands inside them: a reader comment is often an article of its own.
STRONG_WORDS = frozenset("comment comments disqus replies related recommended sidebar".split())
MAIN_WORDS = frozenset("article entry post story content main body text".split())
_LAYOUT = re.compile(r"\b(?:with|has|no|without|show|hide)[-_]", re.I)


#: What a container's name adds to the log-odds: named by tag, role or word, by a layout's word, by a main column's word.
NAMED, LAYOUT, COLUMN = 4.5, 2.5, 2.0
#: Hidden elements.
HARD = -50.0


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    #: what the containers' names say: log-odds, and the element that says so
    place: float
    claim: int
    link_chars: int
    depth: int = 0
    #: depth of the innermost element that holds this block and the one before it
    meet: int = 0
    features: list[float] = field(default_factory=list)


@dataclass
class Open:
    """An open element; a block element with the inline elements open in it."""

    tag: str
    node: int
    place: float
    claim: int
    link: bool
    inline: list[Open] = field(default_factory=list)
    names: Counter = field(default_factory=Counter)

    def cut(self, at: int) -> None:
        for x in self.inline[at:]:
            self.names[x.tag] -= 1
        del self.inline[at:]


def unescape(raw: str) -> str:
    if "&" not in raw:
        return raw
    # numbers beyond any character, too long to be read as one
    return _html.unescape(_NUMBER.sub("\ufffd", raw) if "&#" in raw else raw)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(raw)}


def _place(tag: str, attrs: str, outer: float) -> float:
    """What an element's name says of its content, given what its container said; `outer` if nothing."""
    if outer == HARD:
        return HARD
    words, role = frozenset(), ""
    if attrs and not attrs.isspace():
        a = _attributes(attrs)
        if "hidden" in a or _HIDDEN.search(a.get("style", "")) or a.get("aria-hidden") == "true":
            return HARD
        named = f"{a.get('class', '')} {a.get('id', '')}"
        words = frozenset(w.lower() for token in named.split() if not _LAYOUT.match(token) for w in _CLASS_PARTS.findall(token))
        role = a.get("role", "").lower()
    page = tag in ("html", "body")
    if words & STRONG_WORDS and not words & {"with", "count"} and not page:
        return -NAMED - 0.1  # holds where an article stands inside
    if outer == -NAMED - 0.1:
        return outer
    if tag in MAIN or role == "main":
        return NAMED
    if tag in BOILER or role in BOILER_ROLES:
        return -NAMED
    if tag == "header":
        return NAMED if outer == NAMED else -NAMED
    if not words or page:
        return outer
    if words & (BOILER_WORDS | LAYOUT_WORDS):
        if words & MAIN_WORDS and not words & {"ad", "ads", "advert"}:
            return outer
        return -NAMED if words & BOILER_WORDS else min(outer, -LAYOUT)
    return COLUMN if words & MAIN_WORDS and outer == 0 else outer


#: What the next element of these ends, besides an open paragraph.
_ENDS = {"li": ("li",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
_CONTAINERS = frozenset("ul ol table div article section main nav footer aside header".split())


def parse(page: str) -> list[Block]:
    """The page's text blocks in order, character references decoded, white space collapsed."""
    blocks: list[Block] = []
    stack = [Open("", 0, 0.0, 0, False)]
    open_blocks: Counter = Counter()
    parts: list[str] = []
    linked, pos, next_id, meet = 0, 0, 1, 0
    whole_tags = True  # until a tag is found whose quotes swallow the rest of the page
    ends: dict[str, re.Match | None] = {}

    def flush() -> None:
        nonlocal linked, meet
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack[-1]
                blocks.append(Block(text, own.tag, stack[-2].node if len(stack) > 1 else 0, own.place, own.claim, linked, len(stack), meet))
                meet = len(stack)
            parts.clear()
        linked = 0

    def top() -> Open:
        return stack[-1].inline[-1] if stack[-1].inline else stack[-1]

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            t = top()
            if t.place == HARD and stack[-1].place != HARD:  # a hidden inline element
                return
            text = unescape(raw)
            parts.append(text)
            if t.link:
                linked += len(text.strip())

    def end_of(name: str) -> re.Match | None:
        end = ends.get(name)
        if name not in ends or (end and end.start() < pos):
            end = ends[name] = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
        if end and name in ("audio", "video") and re.compile(rf"<{name}[\s>]", re.I).search(page, pos, end.start()):
            return None  # these don't nest: the end tag is another's
        return end

    def close_to(k: int) -> None:
        nonlocal meet
        for x in stack[k:]:
            open_blocks[x.tag] -= 1
        del stack[k:]
        meet = min(meet, k)

    while True:
        lt = page.find("<", pos)
        if lt < 0:
            break
        say(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            say(page[lt + 9 : end if end >= 0 else len(page)])
            pos = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            pos = end + 1 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, lt + 1)
        if not name:
            say("<")
            pos = lt + 1
            continue
        rest = _REST.match(page, name.end()) if whole_tags else None
        pos = rest.end() if rest else page.find(">", name.end()) + 1
        if not pos:
            pos = len(page)  # no tag ends after this
            break
        whole_tags = bool(rest)
        close = name[0][0] == "/"
        tag = name[0][close:].lower()
        attrs = page[name.end() : pos - 1]
        if tag in OPAQUE:
            if not close and not attrs.endswith("/"):
                if (end := end_of(tag)) or tag in RAW:
                    pos = end.end() if end else len(page)
                else:
                    stack[-1].inline.append(Open(tag, next_id, HARD, 0, top().link))
                    stack[-1].names[tag] += 1
                    next_id += 1
            if tag in ("title", "select", "textarea"):
                flush()
            continue
        if tag == "xmp" and not close:
            end = end_of(tag)
            upto = end.start() if end else len(page)
            if top().place != HARD:
                parts.append(page[pos:upto])
            pos = end.end() if end else len(page)
            continue
        block = tag in BLOCK
        if block:
            flush()
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        own = stack[-1]
        if close:
            if block and open_blocks[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close_to(k)
            elif not block and own.names[tag]:  # an inline end tag never closes a block
                k = len(own.inline) - 1
                while own.inline[k].tag != tag:
                    k -= 1
                own.cut(k)
            continue
        if block:
            # an opaque element left open ends where a block begins
            if any(own.names[x] > 0 for x in own.names.keys() & OPAQUE):
                own.cut(next(i for i, x in enumerate(own.inline) if x.tag in OPAQUE))
            # a paragraph ends where a block begins, items and cells where the next begins
            also = _ENDS.get(tag, ())
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in also):
                close_to(len(stack) - 1)
            if tag in _CONTAINERS:
                stack[-1].cut(0)  # inline elements left open don't reach into the next container
        outer = top()
        place = _place(tag, attrs, outer.place)
        claim = next_id if place != outer.place or place == -NAMED and tag in BOILER else outer.claim
        new = Open(tag, next_id, place, claim, outer.link or tag == "a")
        next_id += 1
        if block:
            stack.append(new)
            open_blocks[tag] += 1
        elif not attrs.endswith("/"):
            stack[-1].inline.append(new)
            stack[-1].names[tag] += 1
    if pos < len(page):
        say(page[pos:])
    flush()
    return [b for b in blocks if b.place != HARD]


_STOPS, _AFTER_STOP = frozenset(".!?…。？！"), "\"'»”)"


def describe(blocks: list[Block]) -> None:
    for b in blocks:
        t = b.text
        words = t.count(" ") + 1
        b.features = [
            1.0, math.log1p(len(t)), b.link_chars / len(t), 1.0 if t[-12:].rstrip(_AFTER_STOP)[-1:] in _STOPS else 0.0, min(3, t.count(",")) / 3.0,
            1.0 if words >= 10 else 0.0, 1.0 if b.tag in ("h1", "h2", "h3") else 0.0, 1.0 if b.tag == "li" else 0.0,
            1.0 if "©" in t or "·" in t or "|" in t else 0.0,
        ]


#: Used where a sample has too few blocks of either label.
DEFAULT_WEIGHTS = (-2.5, 0.55, -4.0, 0.8, 0.6, 0.8, 0.6, -0.8, -2.0)


def fit_weights(features: np.ndarray, label: np.ndarray, least: int = 50, rounds: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; labels 1 main, 0 boilerplate."""
    if min(int(label.sum()), int((1 - label).sum())) < least:
        return DEFAULT_WEIGHTS
    w = np.zeros(features.shape[1])
    # both labels weigh the same, however many menu items there are
    share = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    ridge = np.eye(len(w)) * 0.01 * len(label)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        g = features.T @ (share * (p - label)) + ridge @ w
        h = (features * (share * p * (1 - p) + 1e-9)[:, None]).T @ features + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(x) for x in w)


class FlowNetwork:
    """Integer max-flow by shortest augmenting levels; nodes 0 and 1 are source and sink."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def edge(self, a: int, b: int, forth: int, back: int = 0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def source_side(self) -> list[bool]:
        while True:
            level = [-1] * len(self.head)
            level[0] = 0
            queue = deque([0])
            while queue:
                a = queue.popleft()
                for e in self.head[a]:
                    if self.cap[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[1] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.head)
            path: list[int] = []
            node = 0
            while True:  # a blocking flow with an explicit path
                if node == 1:
                    most = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= most
                        self.cap[e ^ 1] += most
                    k = next(i for i, e in enumerate(path) if not self.cap[e])
                    node = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[node] < len(self.head[node]):
                    e = self.head[node][at[node]]
                    if self.cap[e] and level[self.to[e]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(self.head[node]):
                    path.append(e)
                    node = self.to[e]
                elif path:
                    e = path.pop()
                    node = self.to[e ^ 1]
                    at[node] += 1
                else:
                    break


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each block is main: minimises the costs of labels and of cut edges.  score > 0 speaks for main."""
    n = len(score)
    gain = [round(1000 * s) for s in score]
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, round(1000 * w)))
        near[b].append((a, round(1000 * w)))
    # no cut gives these the other label
    fixed = [gain[i] > 0 if abs(gain[i]) > sum(w for _, w in near[i]) else None for i in range(n)]
    left = [i for i in range(n) if fixed[i] is None]
    if not left:
        return [bool(x) for x in fixed]
    number = {i: k + 2 for k, i in enumerate(left)}
    net = FlowNetwork(len(left) + 2)
    for i in left:
        g = gain[i] + sum(w if fixed[j] else -w for j, w in near[i] if fixed[j] is not None)
        net.edge(0, number[i], g) if g > 0 else net.edge(number[i], 1, -g)
        for j, w in near[i]:
            if j > i and fixed[j] is None:
                net.edge(number[i], number[j], w, w)
    side = net.source_side()
    return [bool(side[number[i]]) if i in number else bool(fixed[i]) for i in range(n)]


#: What a cut edge costs between neighbours in page order and in one container, and what is left of it where the containers' names differ.
NEXT_COST, SIBLING_COST, CONTRAST = 0.7, 0.9, 0.3


def neutral_claims(blocks: list[Block]) -> set[int]:
    """Elements whose names say boilerplate but that hold most of the page's running text, if nothing is called main."""
    if any(b.place > 0 for b in blocks):
        return set()
    prose: Counter = Counter()
    for b in blocks:
        prose[b.claim if b.place < 0 else 0] += len(b.text) - b.link_chars
    return {c for c, n in prose.items() if c and 2 * n > sum(prose.values())}


def label(blocks: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Whether each block is main text."""
    describe(blocks)
    neutral = neutral_claims(blocks)
    place = [0.0 if b.claim in neutral else b.place for b in blocks]
    score = [sum(w * x for w, x in zip(weights, b.features, strict=True)) + p for b, p in zip(blocks, place, strict=True)]
    edges: list[tuple[int, int, float]] = []

    def join(i: int, j: int, cost: float) -> None:
        edges.append((i, j, cost * (1.0 if place[i] == place[j] else CONTRAST)))

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            steps = blocks[i - 1].depth + b.depth - 2 * b.meet
            join(i - 1, i, NEXT_COST * 2 / max(2, steps))
        if b.parent in last:
            join(last[b.parent], i, SIBLING_COST)
        last[b.parent] = i
    return min_cut(score, edges)


def extract(page: str | None, weights: tuple[float, ...] = DEFAULT_WEIGHTS) -> str:
    blocks = parse(page) if page else []
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, weights), strict=True) if keep)


def _describe(most: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, label = [], []
            for page in batch.column("html").to_pylist():
                blocks = (parse(page) if page else [])[:most]
                describe(blocks)
                for b in blocks:
                    if b.place and b.tag != "head":
                        features.append(b.features)
                        label.append(int(b.place > 0))
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.float64())), pa.array(label, pa.int64())], names=["x", "y"])

    return run


def fit_classifier(pages: DataFrame, sample: int = 500, sample_chars: int = 200_000, sample_blocks: int = 400) -> tuple[float, ...]:
    """pages(id, html).  About `sample` pages, those whose id hashes into that share of all, send their blocks' features."""
    n = max(pages.count(), 1)
    few = pages.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < sample).filter(F.length("html") <= sample_chars)
    rows = few.select("html").mapInArrow(_describe(sample_blocks), "x array<double>, y long").toPandas()
    if rows.empty:
        return DEFAULT_WEIGHTS
    return fit_weights(np.array(rows["x"].tolist()), rows["y"].to_numpy().astype(float))


def _run(weights: tuple[float, ...]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract(p, weights) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), text], names=["id", "url", "text"])

    return run


def extract_main(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", sample: int = 500) -> DataFrame:
    """One row a page: id, url, text (blocks joined by a newline).  The classifier's sample is as fit_classifier says."""
    rows = narrow(pages, id=id_column, url=url_column, html=html_column)
    weights = fit_classifier(rows, sample)
    return rows.mapInArrow(_run(weights), "id long, url string, text string")
