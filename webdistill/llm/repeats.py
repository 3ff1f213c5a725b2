"""Finding repeated windows of L units (bytes or words) without listing every window.

Every window of L units selects one of its k-unit grams, the one with the smallest hash (leftmost on
ties).  Equal windows select equal grams at equal offsets, so a window can only repeat where its
selected gram (its *anchor*) repeats.  Neighbouring windows mostly share an anchor: the maximal run of
windows that do is a *block*, stored as one row.  All arithmetic is vectorised over one Arrow batch of
texts laid end to end; windows that would cross a text are dropped.

Windows are hashed by doubling: a window of 2p units is a mixed pair of two windows of p units.  The mix
is not linear, unlike that of a polynomial modulo a power of two, under which some different strings
(Thue-Morse words) have equal hashes whatever the base.  Two families of constants give hashes that are
independent of each other.
"""

from __future__ import annotations

import numpy as np
import xxhash

_POS_BITS = np.uint64(30)  # a batch is at most 2^30 units
#: Odd multipliers of each family.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TIMES = np.uint64(0xD6E8FEB86659FD93)
#: Longer words are hashed one by one.
_LONG_WORD = 256

#: What may not belong to a word: space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * _TIMES
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def pair(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of (a, b); for either one fixed, a bijection of the other."""
    x = a * _SEEDS[which]
    x ^= x >> np.uint64(32)
    x += b
    x *= _TIMES
    return x


class Windows:
    """Hashes of windows of a unit sequence: equal content, equal hash, anywhere."""

    def __init__(self, units: np.ndarray, least: int, which: int = 0):
        """least: no window of fewer units will be asked for."""
        self.which, self.span, self.hashes = which, 1, units
        while 2 * self.span <= least:
            self.hashes = pair(self.hashes[: max(0, len(self.hashes) - self.span)], self.hashes[self.span :], which)
            self.span *= 2

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        """The windows of `size` units that begin at `start`."""
        h = self.hashes[start]
        for step in [*range(self.span, size - self.span, self.span), size - self.span]:
            h = pair(h, self.hashes[start + step], self.which)
        return h

    def all(self, size: int) -> np.ndarray:
        """Every window of `size` units, at most twice the least."""
        n = len(self.hashes) + self.span - size
        return pair(self.hashes[:n], self.hashes[size - self.span : size - self.span + n], self.which) if n > 0 else self.hashes[:0]


_BYTE_UNITS = tuple(mix(np.arange(1, 257, dtype=np.uint64) * b) for b in _SEEDS)


def byte_units(raw: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTE_UNITS[which][raw]


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def word_units(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each word, eight bytes a step."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    h = pair(mix(size.astype(np.uint64) + _SEEDS[which]), eight[start] & _LOW_BYTES[np.minimum(size, 8)], which)
    at, left = 8, np.flatnonzero(size > 8)
    while len(left) and at < _LONG_WORD:
        h[left] = pair(h[left], eight[start[left] + at] & _LOW_BYTES[np.minimum(size[left] - at, 8)], which)
        at += 8
        left = left[size[left] > at]
    for i in left.tolist():
        h[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(raw[start[i] : end[i]]), seed=which + 1)
    return mix(h)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of the texts bounds[i]..bounds[i+1], and each text's word range."""
    ink = np.zeros(len(raw) + 2, dtype=np.int8)
    ink[1:-1] = ~SPACE[raw]
    # a word that ends with its text must not run into the next text
    edge = np.diff(ink)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[(ink[cuts] == 1) & (ink[cuts + 1] == 1)]
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(start, bounds)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, two passes whatever w is."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(x)] = x
    grid = full.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def blocks(units: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """The blocks of all texts: anchor hash, content hash, text index, first and last window start.

    Starts are relative to the whole batch.  The content hash covers the block's first and last window,
    which hold all its units, their distance and the anchor's place.  Two different blocks of one anchor
    have equal content hashes with a chance of 2^-64.
    """
    none = np.zeros(0, dtype=np.int64)
    hashes = Windows(units, k)
    grams = hashes.all(k)
    wide = length - k + 1
    n = len(grams) - wide + 1
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    at = np.arange(len(grams), dtype=np.uint64)
    low = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    best = _sliding_min((grams & ~low) | at, wide)
    pick = (best & low).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(n), side="right") - 1
    inside = np.arange(n) + length <= bounds[text + 1]
    turn = np.ones(n, dtype=bool)
    turn[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    turn[1:] |= inside[1:] & ~inside[:-1]
    first = np.flatnonzero(turn & inside)
    stop = np.flatnonzero(np.append(turn | ~inside, True))
    last = stop[np.searchsorted(stop, first + 1)] - 1
    pos = pick[first]
    anchor = mix(grams[pos] + np.uint64(k))
    place = (pos - first).astype(np.uint64) * _SEEDS[1] + (last - first).astype(np.uint64)
    body = mix(pair(pair(hashes.of(first, length), hashes.of(last, length), 1), mix(place), 1))
    return anchor, body, text[first], first, last


def text_blocks(raw: np.ndarray, bounds: np.ndarray, unit: str, length: int, k: int, most: int = 1_000_000):
    """The blocks of all texts, starts counted in units from each text's start.

    A single text of more than `most` units is read in overlapping parts: a block may then be cut in
    two, which leaves every window in exactly one block.
    """
    if unit == "byte":
        limits, size = bounds, len(raw)
    else:
        start, end, limits = word_spans(raw, bounds)
        size = len(start)
    for a in range(0, max(1, size - length + 1), most):
        b = min(size, a + most + length - 1)
        if b - a < length:
            return
        units = byte_units(raw[a:b]) if unit == "byte" else word_units(raw[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a])
        anchor, body, text, first, last = blocks(units, np.clip(limits - a, 0, b - a), length, k)
        yield anchor, body, text, first + a - limits[text], last + a - limits[text]


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ordered union of half-open intervals; touching ones become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)
    return lo[new], hi[ends]
