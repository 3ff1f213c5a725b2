"""Text primitives with the exact semantics the extraction rules were written for.

White space is the ECMAScript class, lengths count UTF-16 units, and case-insensitive patterns fold ASCII
letters only.  Python's and Java's own notions differ in each of these.
"""

from __future__ import annotations

import re

WS_CHARS = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = "[" + WS_CHARS + "]"
#: The same class for Java and RE2 regular expressions.
JAVA_WS = r"[\t\n\x0B\f\r\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_WS_RUN = re.compile(WS + "+")


def trim(s: str) -> str:
    return s.strip(WS_CHARS)


def collapse(s: str) -> str:
    """Every run of white space to one space."""
    return _WS_RUN.sub(" ", s)


def split_ws(s: str) -> list[str]:
    return [x for x in _WS_RUN.split(s) if x]


def units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) if s.isascii() else len(s) + sum(c > "\uffff" for c in s)


def head_units(s: str, n: int) -> str:
    """The first n UTF-16 units; half a surrogate pair becomes U+FFFD."""
    if len(s) <= n // 2 or s.isascii():
        return s[:n]
    return s.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "replace")


def pad_units(s: str, n: int) -> str:
    return s + " " * max(0, n - units(s))


def sound(s: str) -> str:
    """Joins surrogate pairs and replaces lone surrogates, which UTF-8 can't carry."""
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
