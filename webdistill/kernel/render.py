"""Rendering a tree as Markdown: one bottom-up pass with an explicit stack.

Each element's text is its children's texts joined, passed through the first rule that fits.  Own rules
come before the built-in ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import ClassVar

from ..functions.text import WS, collapse, pad_units, trim, units
from .dom import COMMENT, DOCUMENT, ELEMENT, TEXT, Tree


@dataclass(frozen=True)
class MarkdownOptions:
    """Choices of style.  code_block_style and link_style are accepted and have no effect."""

    heading_style: str = "atx"
    bullet_list_marker: str = "-"
    code_block_style: str = "fenced"
    fence: str = "```"
    em_delimiter: str = "*"
    strong_delimiter: str = "**"
    link_style: str = "inlined"
    hr: str = "---"

    _ALLOWED: ClassVar[dict[str, tuple[str, ...]]] = {
        "heading_style": ("atx", "setext"), "bullet_list_marker": ("*", "-", "+"), "code_block_style": ("fenced", "indented"),
        "fence": ("```", "~~~"), "em_delimiter": ("_", "*"), "strong_delimiter": ("**", "__"),
        "link_style": ("inlined", "referenced"), "hr": ("---", "***", "___"),
    }

    @classmethod
    def of(cls, **chosen: str | None) -> MarkdownOptions:
        """From chosen values; None is unset, values outside the lists raise."""
        given = {k: v for k, v in chosen.items() if v is not None}
        for k, v in given.items():
            if k not in cls._ALLOWED or v not in cls._ALLOWED[k]:
                raise ValueError(f"no such option: {k}={v!r}")
        return cls(**given)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


class NodeView:
    """What a rule sees of an element."""

    def __init__(self, tree: Tree, node: int):
        self.tree, self.node = tree, node

    @property
    def tag(self) -> str:
        return self.tree.tag[self.node]

    @property
    def attributes(self) -> dict[str, str]:
        return self.tree.attrs[self.node]

    @property
    def parent(self) -> NodeView | None:
        p = self.tree.parent[self.node]
        return NodeView(self.tree, p) if p >= 0 and self.tree.kind[p] == ELEMENT else None

    @property
    def children(self) -> list[NodeView]:
        """Child elements."""
        return [NodeView(self.tree, k) for k in self.tree.kids[self.node] if self.tree.kind[k] == ELEMENT]

    @property
    def text(self) -> str:
        return self.tree.text(self.node)


@dataclass(frozen=True)
class Rule:
    """applies: a tag, several tags, or a test of a NodeView.  replace(content, view, options)."""

    applies: str | tuple[str, ...] | Callable[[NodeView], bool]
    replace: Callable[[str, NodeView, MarkdownOptions], str]

    def fits(self, view: NodeView) -> bool:
        if isinstance(self.applies, str):
            return view.tag == self.applies
        return view.tag in self.applies if isinstance(self.applies, tuple | list) else self.applies(view)


_SPECIAL = re.compile(r"[\\*_`\[\]#>~]")
_MARKER = re.compile(rf"(?:\A|(?<=[\n\r\u2028\u2029]))({WS}*)([-+]|[0-9]+\.) ")
_LANGUAGE = re.compile(r"(?:language|lang)-([^" + WS[1:-1] + "]+)")


def escape_markdown(text: str) -> str:
    return _MARKER.sub(r"\1\\\2 ", _SPECIAL.sub(r"\\\g<0>", text))


def finish(text: str) -> str:
    """At most one blank line in a row, no white space round the whole, one newline at the end."""
    return trim(re.sub(r"\n{3,}", "\n\n", text)) + "\n"


def _block(text: str) -> str:
    return f"\n\n{text}\n\n"


def _heading(content: str, level: int, o: MarkdownOptions) -> str:
    if o.heading_style == "setext" and level < 3:
        return _block(content + "\n" + "=-"[level - 1] * units(content))
    return _block("#" * level + " " + content)


def _item(tree: Tree, node: int, content: str, o: MarkdownOptions, numbers: dict[int, dict[int, int]]) -> str:
    up, mark = tree.parent[node], f"{o.bullet_list_marker} "
    if up >= 0 and tree.tag[up] == "ol":
        if up not in numbers:
            numbers[up] = {k: i for i, k in enumerate((k for k in tree.kids[up] if tree.tag[k] == "li"), 1)}
        mark = f"{numbers[up].get(node, 1)}. "
    return mark + trim(content).replace("\n", "\n" + " " * len(mark)) + "\n"


def _code_block(tree: Tree, node: int, o: MarkdownOptions) -> str:
    code = next((k for k in tree.kids[node] if tree.tag[k] == "code"), None)
    found = _LANGUAGE.search(tree.attrs[code].get("class", "")) if code is not None else None
    body = tree.text(node if code is None else code)
    return _block(f"{o.fence}{found[1] if found else ''}\n{body}\n{o.fence}")


def _inline_code(content: str) -> str:
    fence = "`" * (max((len(r) for r in re.findall("`+", content)), default=0) + 1)
    pad = " " if content.startswith("`") or content.endswith("`") else ""
    return fence + pad + content + pad + fence


def _titled(attrs: dict[str, str]) -> str:
    return f' "{attrs["title"]}"' if attrs.get("title") else ""


def _image(attrs: dict[str, str]) -> str:
    source = next((attrs[a] for a in ("src", "data-src", "data-lazy-src") if a in attrs), "")
    return f"![{attrs.get('alt', '')}]({source}{_titled(attrs)})" if source else ""


def _table(tree: Tree, node: int, cell_text: dict[int, str]) -> str:
    rows: list[list[str]] = []
    stack = tree.kids[node][::-1]
    while stack:
        x = stack.pop()
        if tree.tag[x] == "tr":
            cells = [trim(cell_text[k]).replace("|", "\\|").replace("\n", " ") for k in tree.kids[x] if tree.tag[k] in ("td", "th")]
            if cells:
                rows.append(cells)
        elif tree.tag[x] in ("thead", "tbody", "tfoot"):
            stack.extend(reversed(tree.kids[x]))
    if not rows:
        return ""
    wide = max(map(len, rows))
    grid = [r + [""] * (wide - len(r)) for r in rows]
    widths = [max(3, *(units(r[i]) for r in grid)) for i in range(wide)]
    lines = ["| " + " | ".join(pad_units(c, w) for c, w in zip(r, widths, strict=True)) + " |" for r in grid]
    return "\n".join([lines[0], "| " + " | ".join("-" * w for w in widths) + " |", *lines[1:]])


class Renderer:
    def __init__(self, options: MarkdownOptions | None = None, rules: tuple[Rule, ...] = ()):
        self.options = options or MarkdownOptions()
        self.rules = tuple(rules)

    def add_rule(self, rule: Rule) -> None:
        """The last rule added is asked first."""
        self.rules = (rule, *self.rules)

    def render(self, tree: Tree, root: int) -> str:
        return finish(self._fold(tree, root))

    def _fold(self, tree: Tree, root: int) -> str:
        done: dict[int, str] = {}  # finished text of nodes whose parent is still open
        cells: dict[int, str] = {}
        numbers: dict[int, dict[int, int]] = {}  # places of the items of each ordered list
        stack: list[tuple[int, bool, bool]] = [(root, self._inside_pre(tree, root), False)]
        while stack:
            node, verbatim, ready = stack.pop()
            kind = tree.kind[node]
            if kind == TEXT:
                done[node] = tree.data[node] if verbatim else escape_markdown(collapse(tree.data[node]))
            elif kind == COMMENT:
                done[node] = ""
            elif not ready:
                stack.append((node, verbatim, True))
                inner = verbatim or tree.tag[node] == "pre"
                for k in reversed(tree.kids[node]):
                    stack.append((k, inner if tree.parent[k] == node else self._inside_pre(tree, k), False))
            else:
                content = "".join(done.pop(k) for k in tree.kids[node])
                if tree.tag[node] in ("td", "th"):
                    cells[node] = content
                done[node] = content if kind == DOCUMENT else self._replace(tree, node, content, cells, numbers)
        return done[root]

    @staticmethod
    def _inside_pre(tree: Tree, node: int) -> bool:
        up = tree.parent[node]
        while up >= 0:
            if tree.tag[up] == "pre":
                return True
            up = tree.parent[up]
        return False

    def _replace(self, tree: Tree, node: int, content: str, cells: dict[int, str], numbers: dict[int, dict[int, int]]) -> str:
        if self.rules:
            view = NodeView(tree, node)
            for rule in self.rules:
                if rule.fits(view):
                    return rule.replace(content, view, self.options)
        o, tag, attrs = self.options, tree.tag[node], tree.attrs[node]
        match tag:
            case "p" | "figure":
                return _block(content)
            case "h1" | "h2" | "h3" | "h4" | "h5" | "h6":
                return _heading(content, int(tag[1]), o)
            case "blockquote":
                return _block("> " + trim(content).replace("\n", "\n> "))
            case "ul" | "ol":
                return _block(trim(content))
            case "li":
                return _item(tree, node, content, o, numbers)
            case "pre":
                return _code_block(tree, node, o)
            case "hr":
                return _block(o.hr)
            case "br":
                return "  \n"
            case "table":
                return _block(_table(tree, node, cells))
            case "strong" | "b":
                return o.strong_delimiter + trim(content) + o.strong_delimiter if trim(content) else ""
            case "em" | "i":
                return o.em_delimiter + trim(content) + o.em_delimiter if trim(content) else ""
            case "a":
                link = attrs.get("href", "")
                return f"[{content}]({link}{_titled(attrs)})" if link or content else ""
            case "img":
                return _image(attrs)
            case "code":
                up = tree.parent[node]
                return content if up >= 0 and tree.tag[up] == "pre" else _inline_code(content)
            case "figcaption":
                return f"\n*{trim(content)}*\n" if trim(content) else ""
        return content
