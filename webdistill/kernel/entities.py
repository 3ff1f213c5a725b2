"""Character references: the listed names, with or without semicolon, and numbers."""

from __future__ import annotations

import re
from html.entities import html5

from ..functions.text import sound

#: The names that are decoded; their characters are the HTML standard's.
NAMES = (
    "amp lt gt quot apos nbsp iexcl cent pound yen sect copy laquo raquo reg deg plusmn sup2 sup3 micro para middot "
    "frac14 frac12 frac34 iquest times divide ndash mdash lsquo rsquo ldquo rdquo bull hellip prime Prime lsaquo rsaquo "
    "trade larr uarr rarr darr harr minus lowast le ge lang rang ensp emsp thinsp zwnj zwj lrm rlm"
).split()
NAMED = {n: html5[n + ";"] for n in NAMES}

_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+))|([A-Za-z0-9]{1,32}));?")


def _number(digits: str, base: int) -> str:
    digits = digits.lstrip("0")
    code = int(digits, base) if 0 < len(digits) <= 8 else 0
    return chr(code) if 0 < code <= 0x10FFFF else "\ufffd"


def _decoded(m: re.Match) -> str:
    if m[3] is not None:
        return NAMED.get(m[3], m[0])
    return _number(m[1], 16) if m[1] is not None else _number(m[2], 10)


def decode(text: str) -> str:
    """All references of a string; unknown names and bare ampersands stay."""
    if "&" not in text:
        return text
    out = _REFERENCE.sub(_decoded, text)
    return sound(out) if any("\ud800" <= c <= "\udfff" for c in out) else out


def decode_at(text: str, pos: int) -> tuple[str, int]:
    """The reference whose ampersand stands before pos: its character and how far it reaches; else ("&", 0)."""
    m = _REFERENCE.match(text, pos - 1) if 0 < pos <= len(text) and text[pos - 1] == "&" else _REFERENCE.match("&" + text[pos : pos + 64])
    if not m or (m[3] is not None and m[3] not in NAMED):
        return "&", 0
    return sound(_decoded(m)), len(m[0]) - 1
