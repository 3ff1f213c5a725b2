"""Operator 2, suffix-array dedup over bytes.

Every byte that lies in a 200-byte string found at two places is removed.  Windows of 200 bytes are
routed by content: a window's anchor (see ``repeats``) recurs wherever the window recurs, so blocks of
windows whose anchor never recurs hold nothing, and equal blocks are one block with a count.  The
distinct blocks of one anchor form one string; its suffix array (``suffixes``, by linear grouping) puts
equal windows side by side, and a class of equal windows is repeated if its blocks count for two or more
places.  (A string whose blocks all count for two needs no sorting.)  The decisions are then carried
back to all places of each block.

An anchor with very many distinct blocks is dealt over strings of about ``string_blocks`` blocks each.
Classes of its windows then carry a fingerprint, and classes of different strings are summed by it, with
map-side combination; so no anchor, however common, meets in one task.

Defined cases: null or empty text has no bytes.  Repeated rows are copies like any others.  Rows with
equal id and text get equal results.  Bytes are removed as such, so what is kept may end within a
character.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, narrow, tidy
from .passages import BLOCK_ROWS, FingerprintIndex, by_document, keyed, list_blocks
from .repeats import Windows, byte_units, merge, mix
from .suffixes import shares_prefix, sort_suffixes

_DECIDED = "fp long, chk long, lo int, hi int, w1 long, w2 long, n long"


def _cut_blocks(length: int):
    """The bytes of each wanted block of a document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("fp", "chk", "n", "strings")}
            body = []
            for raw, blocks in zip(as_bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True):
                for b in blocks:
                    for c in rows:
                        rows[c].append(b[c])
                    body.append(raw[b["first"] : b["last"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], pa.int64()) for c in rows] + [pa.array(body, pa.binary())], names=[*rows, "body"])

    return run


def _solve(strings: list[list[tuple[int, int, int, int, bytes]]], length: int) -> pa.RecordBatch:
    """strings: (fp, chk, n, strings, bytes) of the blocks of each string.  Rows of _DECIDED."""
    flat = [b for s in strings for b in s]
    laid = []
    for s in strings:
        size = sum(len(b[4]) + 1 for b in s)
        x = np.ones(size + 1, dtype=np.int64)
        x[-1] = 0
        k = 0
        for b in s:
            x[k : k + len(b[4])] = np.frombuffer(b[4], dtype=np.uint8)
            x[k : k + len(b[4])] += 2
            k += len(b[4]) + 1
        laid.append(x)
    text, sa, order = sort_suffixes(laid)
    # block and offset of every position, and whether a whole window starts there
    firsts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).tolist()
    numbers = [k for i in order for k in range(firsts[i], firsts[i + 1])]
    size = np.array([len(flat[k][4]) for k in numbers], dtype=np.int64)
    final = np.zeros(len(flat), dtype=np.int64)
    final[np.array(firsts[1:]) - 1] = 1  # a string's last block is followed by its end as well
    start = np.concatenate([[0], np.cumsum(size + 1 + final[numbers])[:-1]])
    block = np.full(len(text), -1, dtype=np.int64)
    starts = np.repeat(start, size - length + 1) + _within(size - length + 1)
    block[starts] = np.repeat(np.arange(len(size)), size - length + 1)
    # neighbours in the suffix array whose first `length` bytes are the same are one class
    whole = block[sa] >= 0
    pos = sa[whole]
    run = np.cumsum(~shares_prefix(text, sa, np.array([len(laid[i]) for i in order]), length))[whole]
    turn = np.ones(len(pos), dtype=bool)
    turn[1:] = run[1:] != run[:-1]
    group = np.cumsum(turn) - 1
    weight = np.array([flat[k][2] for k in numbers], dtype=np.int64)[block[pos]]
    total = np.bincount(group, weights=weight).astype(np.int64)
    twice = total[group] > 1
    spans = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    # windows found repeated here, as spans of their block
    hit = np.sort(pos[twice])
    if len(hit):
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (block[hit[1:]] != block[hit[:-1]])
        a = hit[new]
        b = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        k = block[a]
        spans = (k, a - start[k], b - start[k] + length, np.zeros(len(a), dtype=np.int64))
    # one member of each class that may continue in another string of its anchor
    many = np.array([flat[k][3] for k in numbers], dtype=np.int64)
    lead = turn & (many[block[pos]] > 1) if len(pos) else turn
    p = pos[lead]
    k = np.concatenate([spans[0], block[p]])
    fp = np.array([flat[i][0] for i in numbers], dtype=np.int64)
    chk = np.array([flat[i][1] for i in numbers], dtype=np.int64)
    none = np.ones(len(spans[0]), dtype=bool)
    units = np.maximum(text - 2, 0)
    key = [mix(Windows(byte_units(units, w), length, w).of(p, length)).view(np.int64) if len(p) else p for w in (0, 1)]
    w = [pa.array(np.concatenate([np.zeros(len(spans[0]), dtype=np.int64), x]), mask=np.concatenate([none, np.zeros(len(p), dtype=bool)])) for x in key]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(fp[k]), pa.array(chk[k]),
            pa.array(np.concatenate([spans[1], p - start[block[p]]]).astype(np.int32)),
            pa.array(np.concatenate([spans[2], p - start[block[p]] + length]).astype(np.int32)),
            *w, pa.array(np.concatenate([spans[3], total[group[lead]]])),
        ],
        names=["fp", "chk", "lo", "hi", "w1", "w2", "n"],
    )


def _within(size: np.ndarray) -> np.ndarray:
    """0..size[0]-1, 0..size[1]-1, ..."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _settled(string: list[tuple[int, int, int, int, bytes]]) -> bool:
    """A string that needs no sorting: it is all of its anchor, and each of its windows stands at two places already."""
    return string[0][3] == 1 and all(b[2] > 1 for b in string)


def _whole(strings: list[list[tuple[int, int, int, int, bytes]]]) -> pa.RecordBatch:
    """Rows of _DECIDED for settled strings: their blocks are repeated from end to end."""
    flat = [b for s in strings for b in s]
    none = pa.nulls(len(flat), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([b[0] for b in flat], pa.int64()), pa.array([b[1] for b in flat], pa.int64()), pa.array([0] * len(flat), pa.int32()), pa.array([len(b[4]) for b in flat], pa.int32()), none, none, pa.array([0] * len(flat), pa.int64())],
        names=["fp", "chk", "lo", "hi", "w1", "w2", "n"],
    )


def _decide(length: int, most: int = 1_500_000):
    """Streams over rows sorted by string; solves whenever about `most` bytes of whole strings are gathered."""

    def both(ready: list[list]) -> Iterator[pa.RecordBatch]:
        settled = [s for s in ready if _settled(s)]
        if settled:
            yield _whole(settled)
        if len(settled) < len(ready):
            yield _solve([s for s in ready if not _settled(s)], length)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[list] = []
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("fp", "chk", "n", "strings", "body", "part")]
            for fp, chk, n, strings, body, part in zip(*columns, strict=True):
                if (fp, part) != last:
                    if size >= most:
                        yield from both(ready)
                        ready, size = [], 0
                    ready.append([])
                    last = (fp, part)
                ready[-1].append((fp, chk, n, strings, body))
                size += len(body)
        if ready:
            yield from both(ready)

    return run


@tidy
def _keep_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, runs, kept = [], [], [], []
        for raw, spans in zip(as_bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True):
            raw = raw or b""
            lo, hi = merge(np.array([s["lo"] for s in spans or ()], dtype=np.int64), np.array([s["hi"] for s in spans or ()], dtype=np.int64))
            total.append(len(raw))
            gone.append(int((hi - lo).sum()))
            runs.append(len(lo))
            edges = [0, *np.stack([lo, hi], axis=1).reshape(-1).tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x, pa.int64()) for x in (total, gone, runs)], pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_substrings(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = 200, gram: int = 40, string_blocks: int = 256,
) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes)."""
    space = Workspace(docs.sparkSession)
    rows = keyed(narrow(docs, id=id_column, text=text_column))
    listed = space.store(rows.mapInArrow(list_blocks("byte", length, gram), BLOCK_ROWS), "listed")
    index = FingerprintIndex(space, "blocks")
    run = index.append(listed.select("fp", "chk", F.lit(1).alias("n")))
    anchors = space.store(run.groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1").select("fp"), "anchors")
    kinds = index.compact(anchors)
    space.drop(anchors)
    found = space.store(listed.join(kinds.hint("merge"), ["fp", "chk"]), "found")
    space.drop(listed)

    # one place of each distinct block, and over how many strings its anchor is dealt
    one = found.groupBy("fp", "chk").agg(F.max("n").alias("n"), F.min(F.struct("id", "th", "first", "last")).alias("at"))
    dealt = kinds.groupBy("fp").agg(F.ceil(F.count("*") / F.lit(string_blocks)).alias("strings"))
    one = space.store(one.select("fp", "chk", "n", "at.*").join(dealt, "fp"), "distinct")
    cut = by_document(one, rows, "first", "last", "fp", "chk", "n", "strings").mapInArrow(_cut_blocks(length), "fp long, chk long, n long, strings long, body binary")
    cut = cut.withColumn("part", F.pmod("chk", "strings")).repartition("fp", "part").sortWithinPartitions("fp", "part")
    decided = space.store(cut.mapInArrow(_decide(length), _DECIDED), "decided")

    loose = decided.filter("w1 is not null")
    again = loose.groupBy("w1", "w2").agg(F.sum("n").alias("all")).filter("all > 1").select("w1", "w2")
    more = loose.filter("n = 1").join(again.hint("merge"), ["w1", "w2"], "left_semi")
    spans = decided.filter("w1 is null").unionByName(more).select("fp", "chk", "lo", "hi")
    placed = found.join(spans.hint("merge"), ["fp", "chk"]).select("id", "th", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    placed = space.store(placed, "spans")
    space.keep(placed)
    return by_document(placed, rows, "lo", "hi", how="left").mapInArrow(_keep_bytes, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
