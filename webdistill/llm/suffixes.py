"""Suffix arrays by linear grouping (Baier 2016), for one string and for many side by side.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix.  Groups are taken in descending
order; each suffix of the group points to the previous suffix of a smaller group, and suffixes that are
pointed at move up out of their group, the higher the more often the group points at them.  Phase 2
walks the array in ascending order and emits each group's suffixes: those whose next smaller suffix
comes first come first.  There is no renaming and no recursion; time is linear.

``suffix_array`` is the plain form.  ``suffix_arrays`` runs the same two phases over many strings in
lockstep: step t takes the t-th group of every string at once, in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """s ends in a 0 that occurs nowhere else; other symbols are positive."""
    n = len(s)
    sa = sorted(range(n), key=s.__getitem__)
    isa, link, size, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, x in enumerate(sa):
        isa[x] = i
        if i and s[sa[i - 1]] != s[x]:
            start = i
        link[x] = start
        size[start] += 1
    end = n - 1
    while end >= 0:
        low = link[sa[end]]
        calls: dict[int, int] = {}
        for x in sorted(sa[low : end + 1]):
            p = x - 1
            while p >= 0 and link[p] >= low:
                p = prev[p]
            prev[x] = p
            if p >= 0:
                calls[p] = calls.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in calls.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved = by_count[c]
            for p in moved:
                g = link[p]
                size[g] -= 1
                to, at = g + size[g], isa[p]
                other = sa[to]
                sa[at], isa[other] = other, at
                sa[to], isa[p] = p, to
            for p in moved:
                g = link[p]
                new = g + size[g]
                link[p] = new
            for p in moved:
                size[link[p]] += 1
        end = low - 1
    free = link[:]  # the next free place of the group that starts here, by group start
    at_start = {}
    done = [False] * n
    sa[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        x = sa[i] - 1
        while x >= 0 and not done[x]:
            g = free[x]
            to = at_start.get(g, g)
            sa[to] = x
            at_start[g] = to + 1
            done[x] = True
            x = prev[x]
    return sa


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0].., start[1].., each `size` long, end to end."""
    total = int(size.sum())
    out = np.ones(total, dtype=np.int64)
    ends = np.cumsum(size)
    out[0] = start[0]
    out[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings laid end to end; each ends in a 0 that occurs nowhere else in it.

    Returns positions in `text`, each string's array in that string's place.
    """
    n = len(text)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    sa = np.lexsort((text, owner))
    isa = np.empty(n, dtype=np.int64)
    isa[sa] = np.arange(n)
    symbol, own = text[sa], owner[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])
    starts = np.flatnonzero(new)
    size = np.zeros(n, dtype=np.int64)
    size[starts] = np.diff(np.append(starts, n))
    link = np.empty(n, dtype=np.int64)
    link[sa] = starts[np.cumsum(new) - 1]
    prev = np.arange(-1, n - 1)  # one step back, until the group of a suffix has been taken
    mark = np.zeros(n, dtype=bool)

    end = base + lengths - 1
    floor = base
    while len(end):
        low = link[sa[end]]
        count = end - low + 1
        member = sa[_ranges(low, count)]
        least = np.repeat(low, count)
        # step back until a smaller group; members step over members by their own steps, so runs halve
        todo = member
        bound = least
        while len(todo):
            p = prev[todo]
            far = (p >= 0) & (link[p] >= bound)
            todo, bound = todo[far], bound[far]
            prev[todo] = prev[p[far]]
        p = prev[member]
        p = p[p >= np.repeat(floor, count)]
        if len(p):
            p.sort()
            first = np.ones(len(p), dtype=bool)
            first[1:] = p[1:] != p[:-1]
            at = np.flatnonzero(first)
            calls = np.diff(np.append(at, len(p)))
            p = p[at]
            group = link[p]
            order = np.lexsort((calls, group))
            p, calls, group = p[order], calls[order], group[order]
            turn = np.ones(len(p), dtype=bool)
            turn[1:] = group[1:] != group[:-1]
            at = np.flatnonzero(turn)
            moved = np.diff(np.append(at, len(p)))
            goal = group[at]
            zone = goal + size[goal] - moved
            slot = _ranges(zone, moved)
            was = isa[p]
            mark[p] = True
            here = sa[slot]
            out = here[~mark[here]]
            mark[p] = False
            gap = was[was < np.repeat(zone, moved)]
            sa[gap], isa[out] = out, gap
            sa[slot], isa[p] = p, slot
            size[goal] -= moved
            turn[1:] |= calls[1:] != calls[:-1]
            at = np.flatnonzero(turn)
            runs = np.diff(np.append(at, len(p)))
            size[slot[at]] = runs
            link[p] = np.repeat(slot[at], runs)
        end = low - 1
        live = end >= floor
        end, floor = end[live], floor[live]

    free = np.arange(n)  # the next free place of the group that starts here
    done = np.zeros(n, dtype=bool)
    last = base + lengths - 1
    sa[base] = last
    done[last] = True
    at, stop, floor = base.copy(), base + lengths, base
    while len(at):
        x = sa[at] - 1
        own = floor
        while True:
            ok = (x >= own) & ~done[np.maximum(x, 0)]
            x, own = x[ok], own[ok]
            if not len(x):
                break
            g = link[x]
            to = free[g]
            sa[to] = x
            free[g] = to + 1
            done[x] = True
            x = prev[x]
        at = at + 1
        live = at < stop
        if not live.all():
            at, stop, floor = at[live], stop[live], floor[live]
    return sa


def sort_suffixes(strings: list[np.ndarray], width: int = 24) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Suffix arrays of all strings, side by side where enough are about as long.

    Returns the concatenated text, its suffix arrays (positions in the text) and the order of strings.
    """
    order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
    lengths = np.array([len(strings[i]) for i in order], dtype=np.int64)
    text = np.concatenate([strings[i] for i in order])
    base = np.concatenate([[0], np.cumsum(lengths)])
    parts = []
    a = 0
    while a < len(order):
        # strings of up to twice the length share a batch
        b = min(int(np.searchsorted(lengths, 2 * lengths[a], side="right")), int(np.searchsorted(base, base[a] + 1_000_000, side="right")))
        b = max(b, a + 1)
        if b - a >= width:
            parts.append(suffix_arrays(text[base[a] : base[b]], lengths[a:b]) + base[a])
        else:
            for k in range(a, b):
                parts.append(np.array(suffix_array(text[base[k] : base[k + 1]].tolist()), dtype=np.int64) + base[k])
        a = b
    return text, np.concatenate(parts), order


def shares_prefix(text: np.ndarray, sa: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of `sa` has its first `length` symbols in common with the one before it in its string.

    Longest common prefixes are found in text order: where the symbols before both suffixes are equal too,
    the prefix is one shorter than that of the suffix one symbol earlier.  Only the other suffixes are
    compared, four symbols a step, until they differ; a string's end differs from all else in it.
    """
    n = len(text)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[first]] = -1  # the least suffix of a string has none before it
    at = np.arange(n)
    known = (before > 0) & (text[at - 1] == text[before - 1])
    known[first] = False
    starts = np.zeros(n + 1, dtype=bool)
    starts[first] = True
    known[starts[before]] = False
    todo = np.flatnonzero(~known)
    common = np.zeros(n, dtype=np.int64)
    packed = np.zeros(n + 4, dtype="<u2")
    packed[:n] = text
    four = np.ndarray((n + 1,), dtype="<u8", buffer=packed, strides=(2,))
    live = todo[before[todo] >= 0]
    step = 0
    while len(live):
        odd = four[live + step] ^ four[before[live] + step]
        differs = odd != 0
        lowest = odd[differs]
        lowest &= ~lowest + np.uint64(1)
        common[live[differs]] = step + np.log2(lowest.astype(np.float64)).astype(np.int64) // 16
        live = live[~differs]
        step += 4
    last = np.maximum.accumulate(np.where(known, 0, at))
    common = common[last] - (at - last)
    return common[sa] >= length
