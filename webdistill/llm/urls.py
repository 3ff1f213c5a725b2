"""Operator 5, URL filters: a bit-parallel wildcard automaton (multiword Shift-And) over all rules at once.

Each rule is a glob over a canonical URL ``.host`` + ``path``.  All globs are packed one after another
into 64-bit words; one step for each character moves every pattern of every URL of a batch.  A ``*`` is
not a position of its own but a loop on the position before it: in the host part it loops on all
characters but ``/``, in the path part on all.  So a host wildcard never crosses into the path.

Defined cases: a null URL or one without ``://`` has empty host and path and is allowed by default.
Repeated rows are judged alike; an empty table gives no rows.  No shuffle, nothing is broadcast but the
rules, which are code parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, tidy


@dataclass(frozen=True)
class Rule:
    """A glob ``host/path``; a host without leading ``*.`` fits its subdomains as well."""

    glob: str
    verdict: str
    #: listed rules are reported by name and win over the others
    listed: bool = False

    @property
    def weight(self) -> int:
        return len(self.glob)


#: Fixed values of the contract.
CONTRACT_RULES = (
    Rule("org/", "allow", True), Rule("example.org/es/", "block", True), Rule("example.org/en/1", "block", True),
    Rule("com/fr/", "allow", True), Rule("com/de/", "block", True),
)
#: Hosts and paths that serve adverts, trackers, logins and machine-made listings.
DEFAULT_GLOBS = (
    Rule("ads.*/", "block"), Rule("*.doubleclick.*/", "block"), Rule("track*.*/pixel*", "block"), Rule("*/wp-login*", "block"),
    Rule("*/cgi-bin/*", "block"), Rule("casino*.*/", "block"), Rule("*/adserver/*", "block"), Rule("*/search/*/page/*", "block"),
    Rule("torrent*.*/", "block"), Rule("xxx*.*/", "block"),
)

_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def canonical(url: str | None) -> tuple[str, str]:
    found = _HOST.search(url) if url else None
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


class ShiftAnd:
    """All globs in one bit vector of several 64-bit words; bytes of UTF-8 are the alphabet."""

    def __init__(self, globs: list[str]):
        positions: list[tuple[int, bool, bool]] = []  # byte, loops on any but '/', loops on any
        self.starts, self.ends, floating = [], [], []
        for glob in globs:
            host, slash, path = glob.partition("/")
            # The canonical host starts with a dot: a rule's host starts after any dot.
            body = [(b, False) for b in b"."] if not host.startswith("*") else []
            body += [(b, False) for b in host.encode()] + [(b, True) for b in (slash + path).encode()]
            self.starts.append(len(positions))
            floating.append(True)
            for b, in_path in body:
                if b == 0x2A and not in_path:
                    if len(positions) > self.starts[-1]:
                        positions[-1] = (positions[-1][0], True, positions[-1][2])
                elif b == 0x2A:
                    positions[-1] = (positions[-1][0], positions[-1][1], True)
                else:
                    positions.append((b, False, False))
            self.ends.append(len(positions) - 1)
        self.n_words = max(1, -(-len(positions) // 64))
        self.symbol = np.zeros((256, self.n_words), dtype=np.uint64)
        self.loop = np.zeros((256, self.n_words), dtype=np.uint64)
        self.begin = np.zeros(self.n_words, dtype=np.uint64)
        self.accept = np.zeros(self.n_words, dtype=np.uint64)
        for i, (b, host_loop, path_loop) in enumerate(positions):
            w, bit = i // 64, np.uint64(1 << (i % 64))
            self.symbol[b, w] |= bit
            if path_loop:
                self.loop[:, w] |= bit
            elif host_loop:
                self.loop[:, w] |= bit
                self.loop[0x2F, w] &= ~bit
        for s, e in zip(self.starts, self.ends, strict=True):
            self.begin[s // 64] |= np.uint64(1 << (s % 64))
            self.accept[e // 64] |= np.uint64(1 << (e % 64))

    def _one(self, key: bytes, host: int) -> np.ndarray:
        """As run() for a single key, with all words of the bit vector as one integer."""
        whole = lambda x: int.from_bytes(x.astype("<u8").tobytes(), "little")
        symbol, loop = [whole(x) for x in self.symbol], [whole(x) for x in self.loop]
        begin, accept = whole(self.begin), whole(self.accept)
        state = seen = 0
        for p, b in enumerate(key):
            moved = (state << 1) & ~begin
            if host >= p:
                moved |= begin
            state = (moved & symbol[b]) | (state & loop[b])
            if not state and p > host:
                break  # nothing begins after the host
            seen |= state & accept
        return np.array([[seen >> e & 1 == 1 for e in self.ends]])

    def run(self, keys: list[tuple[bytes, int]]) -> np.ndarray:
        """keys: canonical bytes and the length of the host part.  A boolean for each key and glob."""
        n = len(keys)
        if n == 1:
            return self._one(*keys[0])
        longest = max((len(k) for k, _ in keys), default=0)
        text = np.zeros((longest, n), dtype=np.uint8)
        length, host = np.array([len(k) for k, _ in keys]), np.array([h for _, h in keys])
        for i, (k, _) in enumerate(keys):
            text[: len(k), i] = np.frombuffer(k, dtype=np.uint8)
        state = np.zeros((n, self.n_words), dtype=np.uint64)
        seen = np.zeros((n, self.n_words), dtype=np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for p in range(longest):
            live = length > p
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            # A pattern's first bit comes from its start, never from the pattern packed before it.
            moved &= ~self.begin
            moved |= np.where((host >= p)[:, None], self.begin, np.uint64(0))
            new = (moved & self.symbol[text[p]]) | (state & self.loop[text[p]])
            state = np.where(live[:, None], new, state)
            seen |= np.where(live[:, None], state, np.uint64(0)) & self.accept
        ends = np.array(self.ends)
        return (seen[:, ends // 64] >> (ends % 64).astype(np.uint64)) & one == one


def _alike(lengths: list[int], most_urls: int = 256, most_chars: int = 1 << 18) -> Iterator[list[int]]:
    """Numbers of URLs of like length together, so that a few long ones don't stretch the rest; very long ones alone."""
    group: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if group and (len(group) >= most_urls or (len(group) + 1) * lengths[i] > most_chars):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _judge(rules: tuple[Rule, ...], default: str, step: int = 2048):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd([r.glob for r in rules])
        weight = np.array([r.weight + (1 << 20) * r.listed for r in rules])
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                parts = [canonical(u) for u in part.column("url").to_pylist()]
                best: list[int] = [-1] * len(parts)
                for group in _alike([len(h) + len(p) for h, p in parts]):
                    keys = [("." + parts[i][0] + parts[i][1]).encode() for i in group]
                    fits = machine.run([(k, 1 + len(parts[i][0].encode())) for k, i in zip(keys, group, strict=True)])
                    score = np.where(fits, weight, -1)
                    for i, j, s in zip(group, score.argmax(axis=1).tolist(), score.max(axis=1).tolist(), strict=True):
                        best[i] = j if s >= 0 else -1
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"),
                    "host": pa.array([h for h, _ in parts], pa.string()), "path": pa.array([p for _, p in parts], pa.string()),
                    "rule": pa.array([rules[j].glob if j >= 0 and rules[j].listed else None for j in best], pa.string()),
                    "glob": pa.array([rules[j].glob if j >= 0 else None for j in best], pa.string()),
                    "verdict": pa.array([rules[j].verdict if j >= 0 else default for j in best], pa.string()),
                })

    return run


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = CONTRACT_RULES + DEFAULT_GLOBS, *, default: str = "allow",
    id_column: str = "page_id", url_column: str = "url",
) -> DataFrame:
    """One row a page: id, host, path, rule (listed rules only), glob (whatever decided), verdict.

    Listed rules win over the others; among either, the longest fitting glob wins.
    """
    return narrow(pages, id=id_column, url=url_column).mapInArrow(
        _judge(rules, default), "id long, host string, path string, rule string, glob string, verdict string"
    )
