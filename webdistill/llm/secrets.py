"""Operator 4, secret scans: assignment-aware lexing on top of three base patterns.

Base spans: ``assign``, ``access`` and ``hex`` patterns, leftmost and non-overlapping for each kind, with
too short matches dropped.  The method then reads the text as source or configuration and gathers pairs
of a name and a value from

* assignments: ``=``, ``:``, ``:=`` or ``=>`` after a name, with or without a type between them,
* calls: ``name("literal")``, ``put("name", "literal")``,
* markup: ``<name>text</name>``, and ``name="..." value="..."`` in elements, objects and lists.

A value is a concatenation of literals (quoted, triple-quoted, prefixed, in brackets or calls, over lines
where brackets or backslashes continue them; the fixed parts of f-strings), of earlier names and, in
configuration style, a bare value; or a list of such.  Constants are propagated through names, so a secret
that is assembled from parts is seen whole.  The names of enclosing objects, in braces or by indentation,
count for what they hold.  Text inside literals is read as well, for the sake of connection strings and logs.

A value is scored by how sensitive its target name is and how random the value looks; literals that reach
the threshold add ``literal`` spans (the literal's inside), unless a base span already covers them.

Row-local, no shuffle, one text in memory at a time.  Defined cases: null or empty text has no spans;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, narrow, tidy

KINDS = ("assign", "access", "hex", "literal")
#: Fixed patterns of the contract; the letters of assign's names are ASCII in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so a run of fewer never matches

_HEX_RUN = b"h" * 24
_HEX_MAP = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_RUN = re.compile(r"[\w$.\-]+")
_FIRST = re.compile(r"[A-Za-z_$]")
#: What may open or close a pair: an operator, a call's bracket before a literal, a comma after one, braces, elements, lines.
_EVENT = re.compile(r"""(?P<op>:=|=>|=(?!=)|:(?!//))|(?P<call>\()(?=\s*+[rRbBuUfF]{0,2}["'`])|(?P<comma>,)(?=\s*+["'`])|(?P<open>\{)|(?P<close>\})|(?P<element><)(?=[A-Za-z_])|(?P<line>\n)""")
_TRIPLE = re.compile(r'''"""((?:[^"\\]++|\\.|"(?!""))*+)"""|\'{3}((?:[^'\\]++|\\.|'(?!''))*+)\'{3}''', re.S)
_QUOTED = re.compile(r'"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|\'([^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+)\'|`([^`]*+)`')
_PREFIX = re.compile(r"""[rRbBuUfF]{1,2}(?=["'])""")
#: Brackets and calls that stand before a literal.
_WRAP = re.compile(r"""(?:(?:new[ \t]++)?[\w$.]*+\(\s*+)++(?=[rRbBuUfF]{0,2}["'`])""")
_FIELD = re.compile(r"\$?\{([^{}\n]*+)\}")
_TYPE = re.compile(r"[ \t]*+[\w.$\[\], |*&<>?]++")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?+>\s*+([^<>]*+)</")
_BLANK, _BLANKS, _REST_OF_LINE = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"(?:\s|\\\n)*+"), re.compile(r"[ \t\r]*+(?=\n|\Z)")
_NAMES_PAIR, _VALUES_PAIR = frozenset("name key id property field variable".split()), frozenset("value val content default text".split())
_IDENT = re.compile(r"[A-Za-z_$][\w$.]*(?![\w(])")
_BARE = re.compile(r"[^\s\"'`,;#(){}\[\]<>]{6,}+")
_JOIN = re.compile(r"(?:[ \t]|\\\r?\n)*+(?:\+|\.\.|\.|&)(?:[ \t]|\\\r?\n)*+\n?[ \t]*+")
#: In brackets lines don't end a value.
_JOIN_OVER_LINES = re.compile(r"""\s*+(?:(?:\+|\.\.|\.|&)\s*+|(?=[rRbBuUfF]{0,2}["'`]))""")
_NEXT_LITERAL = re.compile(r"""(?:[ \t]|\\\r?\n)*+(?=[rRbBuUfF]{0,2}["'])""")
#: Longer values are held as what scoring needs of them, not as text, and need a placeholder for each so many characters to be one.
_PLAIN = 512

#: Name parts and how far each makes a target sensitive.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "apikey": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3,
    "token": 2, "credential": 2, "credentials": 2, "auth": 2, "bearer": 2, "key": 1, "pass": 2, "signature": 1, "cert": 1, "dsn": 2,
}
_PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|change.?me|your|xxx|\*\*\*|\.\.\.|\$\{|\{\{|<|%\(|test|none|null|true|false", re.I)
#: Every place where a placeholder begins, and how long one is at most.
_PLACEHOLDERS, _PLACEHOLDER_CHARS = re.compile(f"(?={_PLACEHOLDER.pattern})", re.I), 11
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    found = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def sensitivity(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0) for p in parts + both), default=0)


class Summary:
    """What scoring needs of a value; that of a concatenation follows from its parts' without the text.

    Names that double themselves make values of 2^k characters: counts are in units of 2^scale, which
    grows once they have 2048 bits and leaves out less than a float can tell.
    """

    __slots__ = ("counts", "n", "scale", "hits", "head", "tail", "blank", "lead", "inner", "trail")

    def __init__(self, text: str = ""):
        body, n = text.strip(), len(text)
        self.counts, self.n, self.scale = dict(Counter(text)), n, 0
        self.hits = sum(1 for _ in _PLACEHOLDERS.finditer(text))
        self.head, self.tail = text[: _PLACEHOLDER_CHARS - 1], text[1 - _PLACEHOLDER_CHARS :]
        # blanks before, within and after what strip() leaves
        self.blank, self.inner = not body, " " in body
        self.lead, self.trail = " " in text[: n - len(text.lstrip())], " " in text[len(text.rstrip()) :]

    def __add__(self, o: Summary) -> Summary:
        s = Summary()
        s.scale = max(self.scale, o.scale)
        down, s.n = s.scale - o.scale, (self.n >> s.scale - self.scale) + (o.n >> s.scale - o.scale)
        s.counts = {k: c >> s.scale - self.scale for k, c in self.counts.items()} if s.scale > self.scale else dict(self.counts)
        for k, c in o.counts.items():
            s.counts[k] = s.counts.get(k, 0) + (c >> down)
        if s.n.bit_length() > 2048:
            s.n, s.scale, s.counts = s.n >> 1024, s.scale + 1024, {k: c >> 1024 for k, c in s.counts.items()}
        across = sum(m.start() < len(self.tail) for m in _PLACEHOLDERS.finditer(self.tail + o.head)) - sum(1 for _ in _PLACEHOLDERS.finditer(self.tail))
        s.hits = sum(-(-h >> s.scale - scale) for h, scale in ((self.hits, self.scale), (o.hits, o.scale), (across, 0)))  # never down to 0
        s.head, s.tail = (self.head + o.head)[: _PLACEHOLDER_CHARS - 1], (self.tail + o.tail)[1 - _PLACEHOLDER_CHARS :]
        s.blank = self.blank and o.blank
        s.lead = self.lead or self.blank and o.lead
        s.trail = o.trail or o.blank and self.trail
        s.inner = self.inner or o.inner or not self.blank and not o.blank and (self.trail or o.lead)
        return s

    def randomness(self) -> float:
        n = self.n
        # a word that makes a short value a placeholder stands in a long key by chance
        if n < 8 or self.hits and (self.inner or _PLAIN * self.hits >= n):
            return 0.0
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c / n)
        classes = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in self.counts)
        if classes < 2 and not all(c.isdigit() for c in self.counts) and n < 32:
            return 0.0
        return bits + 0.3 * (classes - 1) - (1.5 if self.inner else 0.0)


def randomness(value: str) -> float:
    """Bits by symbol frequencies, a little more for mixed classes; 0 for words and placeholders."""
    return Summary(value).randomness()


class Value:
    """A propagated value: its text while short, else its summary; its parts or the span of its literal."""

    __slots__ = ("text", "_summary", "parts", "span", "told")

    def __init__(self, text: str | None, summary: Summary | None, parts: tuple[Value, ...] = (), span: tuple[int, int] | None = None):
        self.text, self._summary, self.parts, self.span, self.told = text, summary, parts, span, False

    @property
    def summary(self) -> Summary:
        return self._summary or Summary(self.text)

    def spans(self) -> Iterator[tuple[int, int]]:
        """Spans of all literals within, but for those of values told before."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                if v.span:
                    yield v.span
                todo.extend(v.parts)


def _leaf(text: str, a: int, b: int) -> Value:
    return Value(text[a:b], None, span=(a, b)) if b - a <= _PLAIN else Value(None, Summary(text[a:b]), span=(a, b))


def _concat(parts: list[Value]) -> Value:
    if len(parts) == 1:
        return parts[0]
    if all(p.text is not None for p in parts) and sum(len(p.text) for p in parts) <= _PLAIN:
        return Value("".join(p.text for p in parts), None, tuple(parts))
    total = parts[0].summary
    for p in parts[1:]:
        total += p.summary
    return Value(None, total, tuple(parts))


class _BareRuns:
    """Bare values from left to right.  Operators inside a run open values that end where it ends: the run
    is read once, and what lies before each value is taken off its counts."""

    def __init__(self, text: str):
        self.text, self.at, self.end = text, 0, 0

    def leaf(self, at: int) -> Value | None:
        if at >= self.end:
            m = _BARE.match(self.text, at)
            if not m:
                return None
            self.at, self.end = m.span()
            self.left: Counter | None = None
        if self.end - at < 6:
            return None
        if self.end - at <= _PLAIN:
            return _leaf(self.text, at, self.end)
        if self.left is None:
            self.left, self.at = Counter(self.text[at : self.end]), at
            self.hits = [m.start() for m in _PLACEHOLDERS.finditer(self.text, at, self.end)]
        self.left -= Counter(self.text[self.at : at])
        self.at = at
        s = Summary(self.text[at : at + _PLACEHOLDER_CHARS - 1])
        s.counts, s.n, s.hits = dict(self.left), self.end - at, len(self.hits) - bisect_left(self.hits, at)
        s.tail = self.text[self.end + 1 - _PLACEHOLDER_CHARS : self.end]
        return Value(None, s, span=(at, self.end))


def _target(head: str) -> str | None:
    """The name that ends the text before an operator, with a quote, a bracket and blanks after it."""
    head = head.removesuffix("\n").rstrip(" \t").removesuffix("]")
    if head[-1:] in ('"', "'", "`"):
        head = head[:-1]
    run = _RUN.match(head[::-1])
    name = run and run[0][::-1]
    first = _FIRST.search(name) if name else None
    return name[first.start() :] if first else None


class _Reader:
    """Values at places of one text, with what its names are known to hold."""

    def __init__(self, text: str):
        self.text, self.known, self.bare = text, {}, _BareRuns(text)
        self.unclosed: set[str] = set()  # triple quotes that nothing closes

    def literal(self, at: int) -> tuple[list[Value], int] | None:
        """The literal at a place: its leaf, or the parts of a formatted one."""
        text = self.text
        start = at
        if m := _PREFIX.match(text, at):
            at = m.end()
        quote = text[at : at + 3]
        m = None
        if quote in ('"""', "'''") and quote not in self.unclosed and not (m := _TRIPLE.match(text, at)):
            self.unclosed.add(quote)
        m = m or _QUOTED.match(text, at)
        if not m:
            return None
        a, b = m.span(m.lastindex)
        if not ("f" in text[start:at].lower() or text[at] == "`") or "{" not in text[a:b]:
            return [_leaf(text, a, b)], m.end()
        parts, past = [], a
        for field in _FIELD.finditer(text, a, b):
            if field.start() > past:
                parts.append(_leaf(text, past, field.start()))
            if field[1] in self.known:
                parts.append(self.known[field[1]])
            past = field.end()
        return parts + ([_leaf(text, past, b)] if b > past else []), m.end()

    def value(self, at: int, bare: bool = True, inside: bool = False) -> tuple[Value | None, int]:
        """A concatenation at a place, and where it ends."""
        text, parts = self.text, []
        while True:
            wrapped = _WRAP.match(text, at)
            at = wrapped.end() if wrapped else at
            inside = inside or bool(wrapped)
            if found := self.literal(at):
                parts += found[0]
                at = found[1]
            elif (m := _IDENT.match(text, at)) and m[0] in self.known:
                parts.append(self.known[m[0]])
                at = m.end()
            else:
                if not parts and bare and (v := self.bare.leaf(at)):
                    parts.append(v)
                break
            join = (_JOIN_OVER_LINES if inside else _JOIN).match(text, at) or _NEXT_LITERAL.match(text, at)
            if not join or join.end() >= len(text):
                break
            at = join.end()
        return (_concat(parts) if parts else None), at

    def values(self, at: int) -> Iterator[Value]:
        """The value at a place, or those of the list there."""
        at = _BLANK.match(self.text, at).end()
        if self.text[at : at + 1] != "[":
            v, _ = self.value(at)
            if v:
                yield v
            return
        while self.text[at : at + 1] in ("[", ","):
            v, end = self.value(_BLANKS.match(self.text, at + 1).end(), bare=False, inside=True)
            if not v:
                return
            yield v
            at = _BLANKS.match(self.text, end).end()


def assignments(text: str) -> Iterator[tuple[str, int, Value]]:
    """(target name, sensitivity of what encloses it, propagated value) in text order."""
    reader = _Reader(text)
    past, line = 0, 0
    before: tuple[str | None, int, str | None] = (None, 0, None)  # target, end and text of the pair before
    named: str | None = None  # the value of the last name="..."
    argument: tuple[str, int] | None = None  # a call's first literal, and where it ends
    braces: list[int] = []
    indents: list[tuple[int, int]] = []
    indent, indent_of = 0, -1
    for event in _EVENT.finditer(text):
        kind, start, end = event.lastgroup, event.start(), event.end()
        if kind == "line":
            line = end
            continue
        if kind == "open":
            braces.append(max(braces[-1] if braces else 0, sensitivity(before[0]) if before[0] and not text[before[1] : start].strip() else 0))
            named, before = None, (None, end, None)
            continue
        if kind == "close":
            if braces:
                braces.pop()
            named = None
            continue
        if kind == "element":
            named = None
            if (m := _ELEMENT.match(text, start)) and text.startswith(m[1], m.end()):
                a, b = m.start(2), m.start(2) + len(m[2].rstrip())
                if b - a >= 6:
                    yield m[1], 0, _leaf(text, a, b)
            continue
        if kind == "comma":
            target = argument[0] if argument and not text[argument[1] : start].strip() else None
            argument = None
        else:
            # no name reaches over an earlier operator
            target = _target(text[past:start])
            if kind == "op" and event[0] == "=" and before[0] and before[1] == past and _TYPE.fullmatch(text, past, start):
                target = before[0]
            past = end
        if not target:
            before = (None, end, None)
            continue
        if indent_of != line:
            indent_of, indent = line, _BLANK.match(text, line).end() - line
            while indents and indents[-1][0] >= indent:
                indents.pop()
        outer = max(braces[-1] if braces else 0, indents[-1][1] if indents else 0)
        if event[0] == ":" and _REST_OF_LINE.match(text, end):
            indents.append((indent, max(indents[-1][1] if indents else 0, sensitivity(target))))
            before = (target, end, None)
            continue
        first = None
        for v in reader.values(end) if kind == "op" else filter(None, [reader.value(_BLANKS.match(text, end).end(), bare=False, inside=True)[0]]):
            if kind == "call":
                if (found := reader.literal(_BLANKS.match(text, end).end())) and len(found[0]) == 1 and found[0][0].text:
                    argument = (found[0][0].text, found[1])
            else:
                reader.known[target] = v
            first = first or v.text
            yield target, outer, v
        last = target.rpartition(".")[2].lower()
        if last in _VALUES_PAIR and named and first:
            yield named, outer, reader.known[target]
        if last in _NAMES_PAIR:
            named = first
        before = (target, end, first)


def literal_spans(text: str, least: float = 5.5) -> list[tuple[int, int, str]]:
    out = set()
    for name, outer, value in assignments(text):
        weight = max(sensitivity(name), outer)
        if weight and (r := value.summary.randomness()) and weight + r >= least:
            out.update(value.spans())
    return [(a, b, "literal") for a, b in sorted(out) if b > a]


def scan_text(raw: bytes | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind."""
    if not raw:
        return []
    text = raw.decode()
    spans = base_spans(text, raw)
    if any(x in raw for x in (b"=", b":", b"(", b"</")):
        base = sorted(spans)
        starts, reach = [a for a, _, _ in base], [-1, *accumulate((b for _, b, _ in base), max)]
        spans += [x for x in literal_spans(text) if reach[bisect_right(starts, x[0])] < x[1]]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


@tidy
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan_text(t)] for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "spans"])


def scan_secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, spans array<struct<kind,start,end>> in code points, end exclusive."""
    return narrow(docs, id=id_column, text=text_column).mapInArrow(
        _run, "id long, spans array<struct<kind: string, start: int, end: int>>"
    )
