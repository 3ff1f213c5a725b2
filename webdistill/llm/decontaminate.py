"""Operator 1, benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Every item's normalised words give windows (13 words; a shorter item is one window).  All windows go
into one automaton; each document is normalised and scanned once, and hits are mapped back to word
numbers and to code-point offsets of the original text.

The automaton is broadcast, so it is built over blocks of items whose windows have at most ``block_states``
characters in all, which bounds its states (some 40 bytes each); a larger benchmark is scanned block by
block, with the hits so far written to the shared folder between blocks, and an item that alone exceeds the
bound is dealt over blocks by window.  No shuffle: documents are judged row by row.

Defined cases: null or empty text has no words, no hits and is clean.  Repeated rows are judged alike.
Items with null id or no words are ignored; repeated item ids count once.  Empty tables give no rows,
or all documents clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, narrow, store, tidy
from .repeats import merge

#: ASCII letters and digits in lower case; every byte of a non-ASCII character belongs to a word.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

STATE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lo", T.ArrayType(T.IntegerType())), T.StructField("hi", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])
RESULT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def normalise(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def windows(words: list[bytes], size: int) -> Iterable[bytes]:
    if not words:
        return ()
    if len(words) < size:
        return (b" ".join(words),)
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Matcher:
    """The automaton over one block of items, each normalised words; built once in each worker that unpickles it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.items, self.size, self._built = [(name, b" ".join(words)) for name, words in items], size, None

    def __getstate__(self):
        return {"items": self.items, "size": self.size, "_built": None}

    def automaton(self):
        if self._built is None:
            import ahocorasick

            of: dict[bytes, set[str]] = {}
            for name, text in self.items:
                for w in windows(text.split(), self.size):
                    of.setdefault(w, set()).add(name)
            built = ahocorasick.Automaton()
            for w, names in of.items():
                built.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(names)))
            if of:
                built.make_automaton()
            self._built = (built, bool(of))
        return self._built

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items whose windows occur."""
        built, some = self.automaton()
        if not some or not words:
            return [], set()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(built.iter(line))
        if not found:
            return [], set()
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        last = np.searchsorted(gaps, [end for end, _ in found])
        names: set[str] = set()
        ranges = []
        for end, (_, (n, of)) in zip(last.tolist(), found, strict=True):
            ranges.append((end - n, end))
            names.update(of)
        return ranges, names


_shared: dict[int, Matcher] = {}


def _matcher(broadcast) -> Matcher:
    """One built automaton for each broadcast in this worker process."""
    key = id(broadcast.value)
    if key not in _shared:
        _shared.clear()
        _shared[key] = broadcast.value
    return _shared[key]


def _scan(broadcast, last: bool, ratio: int, carry: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(broadcast)
        schema = pa.schema(
            [("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
             ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
             ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            if last else
            [("id", pa.int64()), ("text", pa.string()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
        )
        for batch in batches:
            carried = "lo" in batch.schema.names
            ids, texts = batch.column("id").to_pylist(), as_bytes(batch.column("text"))
            before = zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "items")), strict=True) if carried else None
            rows: list[tuple] = []
            for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                words = normalise(text)
                ranges, names = matcher.scan(words)
                lo, hi = [a for a, _ in ranges], [b for _, b in ranges]
                if before:
                    old = next(before)
                    lo, hi, names = lo + old[0], hi + old[1], names | set(old[2])
                a, b = merge(np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)) if lo else ((), ())
                if not last:
                    rows.append((doc, text.decode() if text is not None else None, list(map(int, a)), list(map(int, b)), sorted(names)))
                    continue
                hit = int(sum(b) - sum(a))
                spans = []
                if hit:
                    at = [m.span() for m in _WORD.finditer(text.decode())]
                    spans = [{"start": at[x][0], "end": at[y - 1][1]} for x, y in zip(a, b, strict=True)]
                order = sorted(names)
                rows.append((doc, len(words), hit, order, hashlib.sha256(",".join(order).encode()).hexdigest(), hit > 0 and ratio * hit >= len(words), spans))
            made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], type=f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(made + [batch.column(c) for c in carry], names=[*schema.names, *carry])

    return run


def blocks_of(benchmark: DataFrame, window: int, block_states: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items, or parts of items, in blocks whose windows have a bounded size in all; at least one block, maybe empty."""
    block, size, some = [], 0, False
    for row in benchmark.toLocalIterator():
        words = normalise(row["text"].encode()) if row["id"] is not None and row["text"] else []
        at, many = 0, max(1, len(words) - window + 1) if words else 0
        while at < many:
            first = at
            while at < many and size < block_states:
                size += sum(len(w) + 1 for w in words[at : at + window])
                at += 1
            block.append((str(row["id"]), words[first : at - 1 + window]))
            if size >= block_states:
                yield block
                block, size, some = [], 0, True
    if block or not some:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", window: int = 13, ratio: int = 20,
    block_states: int = 8_000_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: id, n_words, n_hit, items, items_sha256, contaminated, spans, carried columns c0, c1, ...

    contaminated: some word is hit and ``ratio`` times the hit words reach the document's words.
    spans: code-point offsets in the original text of maximal hit runs.
    """
    spark = docs.sparkSession
    own = {f"c{k}": c for k, c in enumerate(carry)}
    state = narrow(docs, id=id_column, text=text_column, **own)
    more = [f for f in state.schema if f.name in own]
    held = None
    for block in blocks_of(narrow(benchmark, id=item_column, text=item_text), window, block_states):
        if held is not None:
            state = store(state.mapInArrow(_scan(held, False, ratio, list(own)), T.StructType([*STATE, *more])), "decontaminate")
        held = spark.sparkContext.broadcast(Matcher(block, window))
    return state.mapInArrow(_scan(held, True, ratio, list(own)), T.StructType([*RESULT, *more]))
