"""A document as parallel arrays; nodes are numbered in document order.

Elements hold child lists and a parent number.  Trees change only by removing nodes, renaming elements
and hanging nodes under a new element, which may leave a node listed under its old parent as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from ..functions.text import WS_CHARS, units
from .scan import Token, tokens

DOCUMENT, ELEMENT, TEXT, COMMENT = 0, 1, 3, 8
KIND_NAMES = {DOCUMENT: "document", ELEMENT: "element", TEXT: "text", COMMENT: "comment"}

#: Element sets of the parser.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre section summary table ul".split()
)
SCOPE_ENDS = frozenset("table html body template".split())
#: An opening element closes the nearest open ones of these names, unless a scope ends first.
IMPLIED_END = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}


class Tree:
    def __init__(self) -> None:
        self.kind: list[int] = [DOCUMENT]
        self.tag: list[str] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.data: list[str] = [""]
        self.parent: list[int] = [-1]
        self.kids: list[list[int]] = [[]]

    def add(self, parent: int, kind: int, tag: str = "", attrs: dict[str, str] | None = None, data: str = "") -> int:
        node = len(self.kind)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs or {})
        self.data.append(data)
        self.parent.append(parent)
        self.kids.append([])
        if parent >= 0:
            self.kids[parent].append(node)
        return node

    def hang(self, parent: int, node: int) -> None:
        """Under a new parent, without leaving the old one's list."""
        self.parent[node] = parent
        self.kids[parent].append(node)

    def remove(self, nodes: Iterable[int]) -> None:
        """Each from the list of its present parent; what has none stays where it is listed."""
        gone: dict[int, set[int]] = {}
        for x in nodes:
            if self.parent[x] >= 0:
                gone.setdefault(self.parent[x], set()).add(x)
                self.parent[x] = -1
        for p, out in gone.items():
            self.kids[p] = [k for k in self.kids[p] if k not in out]

    def descend(self, root: int, enter: Callable[[int], bool] | None = None) -> Iterator[int]:
        """Nodes below root in document order; below a node only if enter(node)."""
        stack = self.kids[root][::-1]
        while stack:
            x = stack.pop()
            yield x
            if self.kids[x] and (enter is None or enter(x)):
                stack.extend(reversed(self.kids[x]))

    def elements(self, root: int) -> Iterator[int]:
        return (x for x in self.descend(root) if self.kind[x] == ELEMENT)

    def by_tag(self, root: int, *names: str) -> Iterator[int]:
        return (x for x in self.elements(root) if self.tag[x] in names)

    def first(self, root: int, name: str) -> int | None:
        return next(self.by_tag(root, name), None)

    def text(self, node: int) -> str:
        if self.kind[node] == TEXT:
            return self.data[node]
        return "".join(self.data[x] for x in self.descend(node) if self.kind[x] == TEXT)

    def measure(self, root: int) -> Measures:
        return Measures(self, root)


class Measures:
    """Text length, length in links, blankness and images of every node from root down, in one pass."""

    def __init__(self, tree: Tree, root: int):
        order = [root, *tree.descend(root)]
        self.length = dict.fromkeys(order, 0)
        self.linked = dict.fromkeys(order, 0)
        self.blank = dict.fromkeys(order, True)
        self.images = dict.fromkeys(order, False)
        for x in reversed(order):
            if tree.kind[x] == TEXT:
                self.length[x] = units(tree.data[x])
                self.blank[x] = not tree.data[x].strip(WS_CHARS)
                continue
            self.images[x] = tree.kind[x] == ELEMENT and tree.tag[x] == "img"
            for k in tree.kids[x]:
                self.length[x] += self.length[k]
                self.blank[x] &= self.blank[k]
                self.images[x] |= self.images[k]
                if tree.kind[k] == ELEMENT:
                    # only outermost links count, each with all its text
                    self.linked[x] += self.length[k] if tree.tag[k] == "a" else self.linked[k]

    def density(self, node: int) -> float:
        return self.linked[node] / self.length[node] if self.length[node] else 0.0


def build(stream: Iterable[Token]) -> Tree:
    tree = Tree()
    stack: list[int] = []
    open_names: Counter[str] = Counter()

    def close_to(i: int) -> None:
        for x in stack[i:]:
            open_names[tree.tag[x]] -= 1
        del stack[i:]

    def push(node: int) -> None:
        stack.append(node)
        open_names[tree.tag[node]] += 1

    def close(name: str) -> None:
        if not open_names[name]:
            return
        for i in range(len(stack) - 1, -1, -1):
            open_tag = tree.tag[stack[i]]
            if open_tag == name:
                close_to(i)
                return
            if open_tag in SCOPE_ENDS:
                return

    for t in stream:
        top = stack[-1] if stack else 0
        if t.kind == "text":
            tree.add(top, TEXT, data=t.data)
        elif t.kind == "comment":
            tree.add(top, COMMENT, data=t.data)
        elif t.kind == "end":
            if t.name not in VOID and open_names[t.name]:
                # no scope holds an end tag back
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if tree.tag[stack[i]] == t.name))
        elif t.kind == "start":
            if t.name in CLOSES_P and tree.tag[top] == "p":
                close_to(len(stack) - 1)
            for name in IMPLIED_END.get(t.name, ()):
                close(name)
            if t.name == "tr" and stack and tree.tag[stack[-1]] == "table":
                push(tree.add(stack[-1], ELEMENT, "tbody"))
            node = tree.add(stack[-1] if stack else 0, ELEMENT, t.name, dict(t.attributes))
            if t.name not in VOID and not t.self_closing:
                push(node)
    return tree


def parse(html: str) -> Tree:
    return build(tokens(html))


def node_rows(tree: Tree) -> list[tuple]:
    """(node_id, parent_id, end_id, depth, sib_pos, kind, tag, attributes, data) of an unchanged tree."""
    n = len(tree.kind)
    end, depth, place = list(range(n)), [0] * n, [0] * n
    for x in range(n):
        for i, k in enumerate(tree.kids[x]):
            depth[k], place[k] = depth[x] + 1, i
    for x in range(n - 1, 0, -1):
        end[tree.parent[x]] = max(end[tree.parent[x]], end[x])
    return [
        (x, tree.parent[x], end[x], depth[x], place[x], KIND_NAMES[tree.kind[x]], tree.tag[x] or None,
         list(tree.attrs[x].items()), tree.data[x] if tree.kind[x] in (TEXT, COMMENT) else None)
        for x in range(n)
    ]
