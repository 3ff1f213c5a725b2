"""Tolerant HTML scanner: jumps from one significant character to the next.

Tokens are tuples (kind, name, attributes, self_closing, data); kind is start, end, text, comment or
doctype.  Never raises: whatever is left open at the end of input is dropped or becomes text as the
rules of each construct say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from ..functions.text import WS
from .entities import decode


class Token(NamedTuple):
    kind: str
    name: str = ""
    attributes: tuple[tuple[str, str], ...] = ()
    self_closing: bool = False
    data: str = ""


#: Elements whose content is not markup; those of RCDATA have references decoded.
RAW_TEXT = frozenset("script style xmp".split())
RCDATA = frozenset("title textarea".split())

_SPACE = " \t\n\r\f"
_TAG_NAME = re.compile(r"[^ \t\n\r\f/>]*")
_ATTR_NAME = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/=>]*")
_BARE_VALUE = re.compile(r"[^ \t\n\r\f>]*")
_GAP = re.compile(r"[ \t\n\r\f]*")
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}{WS}*>", re.I | re.A)


def _read_tag(html: str, pos: int) -> tuple[str, list[tuple[str, str]], bool, int] | None:
    """From the tag's first letter: name, attributes, self-closing, position after '>'.  None if it never ends."""
    n = len(html)
    m = _TAG_NAME.match(html, pos)
    name, pos = m[0].lower(), m.end()
    attributes: list[tuple[str, str]] = []
    while True:
        pos = _GAP.match(html, pos).end()
        if pos >= n:
            return None
        c = html[pos]
        if c == ">":
            return name, attributes, False, pos + 1
        if c == "/":
            if html.startswith(">", pos + 1):
                return name, attributes, True, pos + 2
            pos += 1
            continue
        m = _ATTR_NAME.match(html, pos)
        key, pos = m[0].lower(), _GAP.match(html, m.end()).end()
        value = ""
        if pos < n and html[pos] == "=":
            pos = _GAP.match(html, pos + 1).end()
            if pos >= n:
                return None
            c = html[pos]
            if c in "\"'":
                close = html.find(c, pos + 1)
                if close < 0:
                    return None
                value, pos = html[pos + 1 : close], close + 1
            elif c != ">":
                m = _BARE_VALUE.match(html, pos)
                value, pos = m[0], m.end()
        if pos >= n:
            return None
        attributes.append((key, decode(value)))


def _open_comment_text(rest: str) -> str:
    """What an unterminated comment has gathered: dashes that might have begun its end are not yet part of it."""
    return rest[:-2] if rest.endswith("--") else rest[:-1] if rest.endswith("-") else rest


def tokens(html: str) -> Iterator[Token]:
    n, pos, held = len(html), 0, ""
    while True:
        at = html.find("<", pos)
        text = held + (html[pos:] if at < 0 else html[pos:at])
        held = ""
        if text:
            yield Token("text", data=decode(text))
        if at < 0 or at + 1 >= n:
            return
        c = html[at + 1]
        pos = at + 2
        if c in _LETTER:
            read = _read_tag(html, at + 1)
            if read is None:
                return
            name, attributes, closed, pos = read
            yield Token("start", name, tuple(attributes), closed)
            if name in RAW_TEXT or name in RCDATA:
                end = _raw_end(name).search(html, pos)
                inner = html[pos:] if end is None else html[pos : end.start()]
                if inner:
                    yield Token("text", data=inner if end and name in RAW_TEXT else decode(inner))
                if end is None:
                    return
                yield Token("end", name)
                pos = end.end()
            continue
        bogus = None
        if c == "/":
            if pos >= n:
                return
            if html[pos] in _LETTER:
                read = _read_tag(html, pos)
                if read is None:
                    return
                yield Token("end", read[0])
                pos = read[3]
                continue
            if html[pos] == ">":
                pos += 1
                continue
            bogus = pos
        elif c == "?":
            bogus = at + 1
        elif c == "!":
            if pos >= n:
                return
            if html.startswith("--", pos):
                pos += 2
                if html.startswith(">", pos) or html.startswith("->", pos):
                    yield Token("comment")
                    pos = html.index(">", pos) + 1
                    continue
                end = html.find("-->", pos)
                if end < 0:
                    if left := _open_comment_text(html[pos:]):
                        yield Token("text", data=decode(left))
                    return
                yield Token("comment", data=html[pos:end])
                pos = end + 3
                continue
            if html[pos : pos + 7].upper() == "DOCTYPE":
                end = html.find(">", pos + 7)
                if end < 0:
                    return
                yield Token("doctype", "html")
                pos = end + 1
                continue
            if html.startswith("[CDATA[", pos):
                pos += 7
                end = html.find("]]>", pos)
                if end >= 0:
                    if end > pos:
                        yield Token("text", data=decode(html[pos:end]))
                    pos = end + 3
                continue
            bogus = pos
        if bogus is not None:
            # the first character belongs to the comment even if it is '>'
            end = html.find(">", bogus + 1)
            if end < 0:
                yield Token("text", data=decode(html[bogus:]))
                return
            yield Token("comment", data=html[bogus:end])
            pos = end + 1
            continue
        # no tag: the character after '<' is taken with it, whatever it is
        held = "<" + c
