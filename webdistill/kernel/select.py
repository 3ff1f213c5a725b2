"""A CSS subset: tag, #id, .class, [attr], [attr=value], compounds, and descent by a space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from ..functions.text import split_ws, trim
from .dom import ELEMENT, Tree


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    #: (name, value); value None asks for presence only
    attributes: tuple[tuple[str, str | None], ...] = ()

    def fits(self, tree: Tree, node: int) -> bool:
        attrs = tree.attrs[node]
        if self.tag is not None and tree.tag[node] != self.tag:
            return False
        if self.id is not None and attrs.get("id", "") != self.id:
            return False
        if self.classes and not set(self.classes) <= set(split_ws(attrs.get("class", ""))):
            return False
        return all(name in attrs and (value is None or attrs[name] == value) for name, value in self.attributes)


_PIECE = re.compile(
    r"""(?P<sort>[.#]?)(?P<name>[A-Za-z0-9_-]+)
      | \[(?P<attr>[^=\]]*)(?:=(?:"(?P<dq>[^"]*)"?|'(?P<sq>[^']*)'?|(?P<bare>[^\]]*)))?\]?""",
    re.X | re.S,
)


def _split(text: str) -> list[str]:
    """At spaces outside brackets."""
    parts, depth, word = [], 0, ""
    for c in text:
        if c == " " and depth == 0:
            parts.append(word)
            word = ""
            continue
        depth += (c == "[") - (c == "]")
        word += c
    return [p for p in [*parts, word] if p]


def _compound(text: str) -> Compound:
    tag = node_id = None
    classes: list[str] = []
    attributes: list[tuple[str, str | None]] = []
    at = 0
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            what = {".": "expected class name after '.'", "#": "expected id after '#'"}.get(text[at], f"unexpected character '{text[at]}'")
            raise SelectorError(f'Invalid selector: {what} in "{text}"')
        if m["name"] is not None:
            if m["sort"] == ".":
                classes.append(m["name"])
            elif m["sort"] == "#":
                node_id = m["name"]
            else:
                tag = m["name"].lower()
        else:
            name = trim(m["attr"])
            if not name:
                raise SelectorError(f'Invalid selector: empty attribute in "{text}"')
            bare = None if m["bare"] is None else trim(m["bare"])
            attributes.append((name, m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else bare))
        at = m.end()
    return Compound(tag, node_id, tuple(classes), tuple(attributes))


@lru_cache(maxsize=1024)
def compile_selector(text: str) -> tuple[Compound, ...]:
    """Compounds from ancestor to target; raises SelectorError."""
    if not trim(text):
        raise SelectorError("Invalid selector: empty string")
    parts = _split(trim(text))
    if not parts:
        raise SelectorError(f'Invalid selector: "{text}"')
    return tuple(_compound(p) for p in parts)


def matches(tree: Tree, node: int, chain: tuple[Compound, ...]) -> bool:
    if not chain or not chain[-1].fits(tree, node):
        return False
    above = tree.parent[node]
    for step in reversed(chain[:-1]):
        # the nearest fitting ancestor serves: descent is the only combinator
        while above >= 0 and not (tree.kind[above] == ELEMENT and step.fits(tree, above)):
            above = tree.parent[above]
        if above < 0:
            return False
        above = tree.parent[above]
    return True


def select_all(tree: Tree, root: int, text: str) -> Iterator[int]:
    """Matching elements below root in document order; ancestors above root count."""
    chain = compile_selector(text)
    return (x for x in tree.elements(root) if matches(tree, x, chain))


def select_one(tree: Tree, root: int, text: str) -> int | None:
    return next(select_all(tree, root, text), None)
