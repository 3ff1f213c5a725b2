"""Catalyst expressions for everything that is flat text: no Python worker on these paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import distill as K
from .text import JAVA_WS

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(c: Name) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), rf"\A{JAVA_WS}+", ""), rf"{JAVA_WS}+\z", "")


def collapse_ws(c: Name) -> Column:
    return F.regexp_replace(_c(c), JAVA_WS + "+", " ")


def u16_length(c: Name) -> Column:
    """Length in UTF-16 units: characters, and one more for each beyond the basic plane."""
    c = _c(c)
    return F.char_length(c) + F.char_length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def md_escape(c: Name) -> Column:
    special = F.regexp_replace(_c(c), r"([\\*_`\[\]#>~])", r"\\$1")
    return F.regexp_replace(special, rf"(\A|(?<=[\n\r\x{{2028}}\x{{2029}}]))({JAVA_WS}*)([-+]|[0-9]+\.) ", r"$2\\$3 ")


def finish_markdown(c: Name) -> Column:
    return F.concat(js_trim(F.regexp_replace(_c(c), r"\n{3,}", "\n\n")), F.lit("\n"))


def excerpt(c: Name) -> Column:
    """First 200 characters of the trimmed text, white space collapsed.  Counts characters, as all of the basic plane do."""
    return js_trim(collapse_ws(F.substring(js_trim(c), 1, 200)))


def base_score(tag: Name) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for score, tags in K.BASE_SCORES.items():
        out = out.when(_c(tag).isin(tags), F.lit(score))
    return out.otherwise(F.lit(0))


def _finds(c: Column, words: list[str]) -> Column:
    return c.rlike("(?i)" + K.word_pattern(words).replace("$", r"\z"))


def names_of(cls: Name, node_id: Name) -> Column:
    return F.concat(F.coalesce(_c(cls), F.lit("")), F.lit(" "), F.coalesce(_c(node_id), F.lit("")))


def is_positive(names: Name) -> Column:
    return _finds(_c(names), K.POSITIVE_WORDS)


def is_negative(names: Name) -> Column:
    return _finds(_c(names), K.NEGATIVE_WORDS)


def class_weight(names: Name) -> Column:
    hit = lambda c: F.when(c, F.lit(25)).otherwise(F.lit(0))
    return hit(is_positive(names)) - hit(is_negative(names))


def is_unlikely(names: Name) -> Column:
    return _finds(_c(names), K.UNLIKELY_WORDS) & ~_finds(_c(names), K.MAYBE_WORDS)


def paragraph_score(text: Name) -> Column:
    t = _c(text)
    commas = F.char_length(t) - F.char_length(F.translate(t, ",、", ""))
    return 1 + commas + F.least(F.floor(u16_length(t) / 100).cast("int"), F.lit(3))


def attribute(attrs: Name, name: str) -> Column:
    """Value of an attribute in an array of (name, value), else null."""
    return F.get(F.filter(_c(attrs), lambda a: a["name"] == name), F.lit(0))["value"]


def url_origin(url: Name) -> Column:
    """scheme://host[:port] in lower case; null if there is none."""
    found = F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def url_path(url: Name) -> Column:
    """Path with query, at least '/'."""
    found = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^#]*)", 1)
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def robots_regex(pattern: Name) -> Column:
    """A path pattern as a Java regular expression: '*' anything, a final '$' the end, else a prefix.

    Pieces between stars are atomic groups at their first place, so that matching never backtracks.
    """
    p = _c(pattern)
    end = p.endswith("$")
    body = F.when(end, F.substring(p, F.lit(1), F.char_length(p) - 1)).otherwise(p)
    parts = F.split(F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1"), r"\*", -1)
    rest = F.slice(parts, F.lit(2), F.size(parts))
    some = F.size(rest) > 0
    inner = F.when(end & some, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    anything = r"[^\n\r\x{2028}\x{2029}]*"
    groups = F.array_join(F.transform(F.filter(inner, lambda x: x != ""), lambda x: F.concat(F.lit(f"(?>{anything}?"), x, F.lit(")"))), "")
    last = F.when(end & some, F.concat(F.lit(anything), F.element_at(rest, -1))).otherwise(F.lit(""))
    return F.concat(F.lit("^"), F.get(parts, F.lit(0)), groups, F.coalesce(last, F.lit("")), F.when(end, F.lit(r"\z")).otherwise(F.lit("")))


def robots_specificity(pattern: Name) -> Column:
    return u16_length(F.translate(_c(pattern), "*$", ""))
