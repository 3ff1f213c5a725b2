"""Finding a page's main content: pruning, scoring and cleaning, and the page's metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import floor

from ..functions.text import collapse, head_units, trim, units
from .dom import ELEMENT, Measures, Tree, parse
from .render import MarkdownOptions, Renderer, Rule
from .select import select_all, select_one

#: Word lists tested anywhere in class and id, ASCII letters in either case.
POSITIVE_WORDS = "article body content entry hentry h-entry main page pagination post text blog story".split()
NEGATIVE_WORDS = [
    "-ad-", "hidden", "^hid$", " hid$", " hid ", "^hid ", "banner", "combx", "comment", "com-", "contact", "footer", "gdpr", "masthead",
    "media", "meta", "outbrain", "promo", "related", "scroll", "share", "shoutbox", "sidebar", "skyscraper", "sponsor", "shopping",
    "tags", "widget",
]
BYLINE_WORDS = "byline author dateline writtenby p-author".split()
UNLIKELY_WORDS = (
    "banner breadcrumbs combx comment community cover-wrap disqus extra footer gdpr header legends menu related remark replies rss "
    "shoutbox sidebar skyscraper social sponsor supplemental ad-break agegate pagination pager popup yom-resolve"
).split()
MAYBE_WORDS = "and article body column content main shadow".split()
STRIPPED = frozenset("script style noscript iframe form button input select textarea nav footer header".split())
CONTENT_TAGS = frozenset("p pre td".split())
KEEPS_DIV = frozenset("blockquote dl div img ol p pre table ul".split())
BASE_SCORES = {
    5: "div article section".split(), 3: "pre td blockquote".split(), -3: "address ul ol dl dd li form".split(),
    -5: "h1 h2 h3 h4 h5 h6 th".split(),
}
SCORE_BY_TAG = {t: s for s, tags in BASE_SCORES.items() for t in tags}
#: What a paragraph's score is divided by at each ancestor, from the parent up.
DIVISORS = (1, 2, 6, 9, 12, 15)
TITLE_SEPARATORS = (" - ", " | ", " — ", " :: ", " / ")
NEVER_UNLIKELY = frozenset("body article main".split())
NEVER_DENSE = frozenset("p pre code blockquote".split())


def word_pattern(words: list[str]) -> str:
    return "|".join(words)


def _any(words: list[str]) -> re.Pattern:
    return re.compile(word_pattern(words).replace("$", r"\Z"), re.I | re.A)


POSITIVE, NEGATIVE, BYLINE, UNLIKELY, MAYBE = map(_any, (POSITIVE_WORDS, NEGATIVE_WORDS, BYLINE_WORDS, UNLIKELY_WORDS, MAYBE_WORDS))


@dataclass(frozen=True)
class ExtractOptions:
    char_threshold: int = 500
    top_candidates: int = 5
    keep_images: bool = True
    remove: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    select: str | None = None
    markdown: MarkdownOptions = field(default_factory=MarkdownOptions)
    rules: tuple[Rule, ...] = ()


def named(tree: Tree, node: int) -> str:
    return tree.attrs[node].get("class", "") + " " + tree.attrs[node].get("id", "")


def class_weight(text: str) -> int:
    return 25 * bool(POSITIVE.search(text)) - 25 * bool(NEGATIVE.search(text))


def paragraph_score(text: str) -> int:
    return 1 + text.count(",") + text.count("、") + min(floor(units(text) / 100), 3)


# ── metadata ──


def _meta(tree: Tree, wanted: tuple[str, ...], keys: tuple[str, ...]) -> str | None:
    """Content of the first meta element whose first present key names one of wanted."""
    for x in tree.by_tag(0, "meta"):
        a = tree.attrs[x]
        name = next((a[k] for k in keys if k in a), "")
        if name in wanted and a.get("content"):
            return trim(a["content"])
    return None


def title(tree: Tree) -> str:
    found = _meta(tree, ("og:title", "twitter:title"), ("property", "name"))
    if found is not None:
        return found
    if (x := tree.first(0, "title")) is not None:
        text = trim(tree.text(x))
        for mark in TITLE_SEPARATORS:
            cut = text.rfind(mark)
            if cut > 0 and units(text[:cut]) > units(text) * 0.3:
                text = trim(text[:cut])
                break
        if text:
            return text
    x = tree.first(0, "h1")
    return trim(tree.text(x)) if x is not None else ""


def byline(tree: Tree) -> str | None:
    found = _meta(tree, ("author",), ("name",))
    if found is not None:
        return found
    for x in tree.elements(0):
        if BYLINE.search(named(tree, x) + " " + tree.attrs[x].get("rel", "")):
            text = trim(tree.text(x))
            if 0 < units(text) < 200:
                return text
    return None


def site_name(tree: Tree) -> str | None:
    return _meta(tree, ("og:site_name",), ("property", "name"))


def excerpt(text: str) -> str:
    return trim(collapse(head_units(trim(text), 200)))


# ── pruning ──


def _drop(tree: Tree, root: int, unwanted) -> None:
    """Remove the elements below root that unwanted(node) tells; True also keeps us from looking inside."""
    gone: list[int] = []

    def enter(x: int) -> bool:
        return not gone or gone[-1] != x

    for x in tree.descend(root, enter):
        if tree.kind[x] == ELEMENT and unwanted(x):
            gone.append(x)
    tree.remove(gone)


def _body(tree: Tree) -> int:
    found = tree.first(0, "body")
    if found is not None:
        return found
    body = tree.add(-1, ELEMENT, "body")
    for x in list(tree.kids[0]):
        if tree.kind[x] == ELEMENT:
            tree.hang(body, x)
    return body


def _shielded(tree: Tree, body: int, include: tuple[str, ...]) -> set[int]:
    out: set[int] = set()
    for text in include:
        for x in select_all(tree, body, text):
            while x >= 0 and tree.kind[x] == ELEMENT and x not in out:
                out.add(x)
                x = tree.parent[x]
    return out


def _prune(tree: Tree, body: int, shield: set[int]) -> None:
    _drop(tree, body, lambda x: tree.tag[x] in STRIPPED)

    def unlikely(x: int) -> bool:
        if tree.tag[x] in NEVER_UNLIKELY or x in shield:
            return False
        text = named(tree, x)
        return len(text) > 1 and bool(UNLIKELY.search(text)) and not MAYBE.search(text)

    _drop(tree, body, unlikely)
    for x in list(tree.by_tag(body, "div")):
        if not any(tree.tag[k] in KEEPS_DIV for k in tree.kids[x]):
            tree.tag[x] = "p"


# ── scoring ──


def scores(tree: Tree, body: int) -> dict[int, float]:
    """Candidates in the order they were first touched."""
    found: dict[int, float] = {}
    leaf = lambda x: tree.tag[x] not in CONTENT_TAGS
    for x in tree.descend(body, leaf):
        if tree.kind[x] != ELEMENT or leaf(x):
            continue
        text = tree.text(x)
        if units(text) < 25:
            continue
        own = paragraph_score(text)
        up = tree.parent[x]
        for divisor in DIVISORS:
            if up < 0 or tree.kind[up] != ELEMENT:
                break
            if up not in found:
                found[up] = SCORE_BY_TAG.get(tree.tag[up], 0) + class_weight(named(tree, up))
            found[up] += own / divisor
            up = tree.parent[up]
    return found


def top_candidate(tree: Tree, found: dict[int, float], most: int) -> int | None:
    passes: list[Measures] = []  # one for all candidates below one element

    def density(x: int) -> float:
        m = next((m for m in passes if x in m.length), None)
        if m is None:
            up = x
            while up in found:
                up = tree.parent[up]
            m = tree.measure(max(up, 0))
            if x not in m.length:
                m = tree.measure(x)
            passes.append(m)
        return m.density(x)

    final = [(s * (1 - density(x)), x) for x, s in found.items()]
    best = sorted(final, key=lambda f: -f[0])[:most]
    if not best:
        return None
    x = best[0][1]
    if tree.tag[x] == "div":
        inner = [k for k in tree.kids[x] if tree.tag[k] in ("div", "article", "section")]
        if len(inner) == 1:
            return inner[0]
    return x


def with_siblings(tree: Tree, top: int) -> int:
    """The candidate together with long, hardly linked paragraphs beside it, under a new element."""
    up = tree.parent[top]
    if up < 0 or tree.kind[up] != ELEMENT:
        return top
    measures = tree.measure(up)
    good = [
        k for k in tree.kids[up]
        if k == top or (tree.kind[k] == ELEMENT and tree.tag[k] == "p" and measures.length[k] >= 80 and measures.density(k) < 0.25)
    ]
    if len(good) <= 1:
        return top
    wrapper = tree.add(-1, ELEMENT, "div")
    for k in good:
        tree.hang(wrapper, k)
    return wrapper


def clean(tree: Tree, root: int, keep_images: bool, shield: set[int]) -> None:
    _drop(tree, root, lambda x: tree.tag[x] in STRIPPED)
    m: Measures = tree.measure(root)
    _drop(tree, root, lambda x: x not in shield and bool(NEGATIVE.search(named(tree, x))) and m.length[x] < 200)
    m = tree.measure(root)
    void = frozenset(("br", "hr", "img"))
    gone = [x for x in tree.elements(root) if m.blank[x] and not (keep_images and m.images[x]) and tree.tag[x] not in void]
    tree.remove(gone)
    m = tree.measure(root)
    _drop(tree, root, lambda x: x not in shield and tree.tag[x] not in NEVER_DENSE and m.density(x) > 0.5 and m.length[x] < 500)
    for x in tree.by_tag(root, "img"):
        a = tree.attrs[x]
        if not a.get("src"):
            late = next((a[k] for k in ("data-src", "data-lazy-src", "data-srcset") if k in a), "")
            if late:
                a["src"] = late


def main_content(tree: Tree, o: ExtractOptions) -> int:
    """The element that holds the content; prunes and cleans the tree on the way."""
    body = _body(tree)
    for text in o.remove:
        tree.remove(list(select_all(tree, body, text)))
    shield = _shielded(tree, body, o.include)
    _prune(tree, body, shield)
    if o.select and (chosen := select_one(tree, body, o.select)) is not None:
        clean(tree, chosen, o.keep_images, shield)
        return chosen
    top = top_candidate(tree, scores(tree, body), o.top_candidates)
    article = with_siblings(tree, body if top is None else top)
    clean(tree, article, o.keep_images, shield)
    if article != body:
        found = units(trim(tree.text(article)))
        if found < o.char_threshold:
            clean(tree, body, o.keep_images, shield)
            if units(trim(tree.text(body))) > found:
                return body
    return article


@dataclass(frozen=True)
class Page:
    title: str | None = None
    markdown: str | None = None
    excerpt: str | None = None
    byline: str | None = None
    site_name: str | None = None


FIELDS = ("title", "markdown", "excerpt", "byline", "site_name")


def distill(html: str, o: ExtractOptions | None = None, fields: tuple[str, ...] = FIELDS) -> Page:
    """The wanted fields of one page; metadata alone needs no scoring and no rendering."""
    o = o or ExtractOptions()
    tree = parse(html)
    out: dict[str, str | None] = {}
    for name, read in (("title", title), ("byline", byline), ("site_name", site_name)):
        if name in fields:
            out[name] = read(tree)
    if "markdown" in fields or "excerpt" in fields:
        content = main_content(tree, o)
        if "excerpt" in fields:
            out["excerpt"] = excerpt(tree.text(content))
        if "markdown" in fields:
            out["markdown"] = Renderer(o.markdown, o.rules).render(tree, content)
    return Page(**out)
