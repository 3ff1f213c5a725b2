"""Operator 7, line dedup: a sharded minimal perfect hash over distinct line hashes.

A line's key is the line without blanks at both ends, A-Z in lower case.  Each document lists its
distinct keys of at least ``least_chars`` code points as 128-bit hashes; counts are summed with map-side
combination, so a line that a third of all documents hold is one row for each task.  Hashes in at least
``least_docs`` documents are dealt by hash to shards of bounded size; each shard becomes a minimal
perfect hash with three arrays beside it: fingerprint, count and the largest doc_id.  Documents then
probe the arrays; lines are never joined.

Shards of at most ``group_bytes`` together are broadcast and probed where the text is read.  Beyond that the
hashes of long lines go to the shards instead, once for the whole corpus: a shard's arrays come first in its
part, its lines stream past them, and only the numbers of lines to drop return to the documents.  A shard whose
frequent lines are held more than ``part_lines`` times is dealt over as many parts more by document, each with
its own copy of the arrays, so that a line which a third of all documents hold is no task of its own.  A task
holds one shard's arrays and one batch.

Defined cases: null or empty text is one empty line.  Every row counts as a document of its own; rows
that share the largest doc_id all keep their lines.  A null doc_id is smaller than any other.  Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, as_bytes, narrow, store, text_key, tidy
from .repeats import mix

_NO_ID = -(1 << 63)
#: Fingerprint, count and keeper of a frequent line, and its share of the perfect hash.
_LINE_BYTES = 32
_BLANK_BYTES = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK_BYTES).lower()


def n_code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode())


def long_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """All lines; the numbers and keys of those whose key is long enough."""
    lines = (text or b"").split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        # a code point is a byte at least, so most short lines are told by their length alone
        if len(line) >= least and n_code_points(k := line_key(line)) >= least:
            at.append(i)
            keys.append(k)
    return lines, at, keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _list_keys(least: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, docs = [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                for k in set(long_keys(text, least)[2]):
                    h = xxhash.xxh3_128_intdigest(k)
                    high.append(_signed(h >> 64))
                    low.append(_signed(h & 0xFFFFFFFFFFFFFFFF))
                    docs.append(_NO_ID if doc is None else doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (high, low, docs)], names=["h", "f", "doc"])

    return run


class PerfectHash:
    """Minimal perfect hash by levels: a level keeps the keys that are alone in their cell."""

    def __init__(self, levels: list[np.ndarray], ranks: list[int]):
        self.levels, self.ranks = levels, ranks
        self._counts = [np.concatenate([[0], np.cumsum(b)]) for b in levels]

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct 64-bit values."""
        levels, ranks, left, total = [], [], keys, 0
        while len(left):
            size = 2 * len(left) + 1
            cell = cls._cell(left, len(levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            levels.append(alone)
            ranks.append(total)
            total += int(alone.sum())
            left = left[~alone[cell]]
        return cls(levels, ranks)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; any place or -1 for a key that wasn't built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            cell = self._cell(keys[todo], level, len(bits))
            hit = bits[cell]
            out[todo[hit]] = self.ranks[level] + self._counts[level][cell[hit]]
            todo = todo[~hit]
        return out


def _shard(table: pa.Table) -> pa.Table:
    """All frequent hashes of one shard to one row of arrays."""
    h = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
    # equal first halves of different lines: the first by second half keeps the place, the rest go to a list
    order = np.lexsort((table.column("f").to_numpy(), h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    place = np.full(len(h), -1, dtype=np.int64)
    main, extra = order[new], order[~new]
    built = PerfectHash.build(h[main])
    place[main] = built.index(h[main])
    columns = {c: table.column(c).to_numpy() for c in ("f", "n", "doc")}
    arrays = {c: np.zeros(len(main), dtype=np.int64) for c in columns}
    for c, values in columns.items():
        arrays[c][place[main]] = values[main]
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
        "levels": pa.array([[np.packbits(b).tobytes() for b in built.levels]], pa.list_(pa.binary())),
        "sizes": pa.array([[len(b) for b in built.levels]], pa.list_(pa.int64())),
        "ranks": pa.array([built.ranks], pa.list_(pa.int64())),
        "finger": pa.array([arrays["f"].tobytes()], pa.binary()), "count": pa.array([arrays["n"].astype(np.int64).tobytes()], pa.binary()),
        "keep": pa.array([arrays["doc"].tobytes()], pa.binary()),
        "extra": pa.array([[int(x) for i in extra for x in (h[i].view(np.int64), columns["f"][i], columns["doc"][i])]], pa.list_(pa.int64())),
    })


_SHARD = "shard long, levels array<binary>, sizes array<long>, ranks array<long>, finger binary, count binary, keep binary, extra array<long>"


class Shards:
    """Shards as probed by documents or by their lines."""

    def __init__(self, n_shards: int, rows: list):
        self.n_shards, self.rows, self._built = n_shards, rows, None

    def __getstate__(self):
        return {"n_shards": self.n_shards, "rows": self.rows, "_built": None}

    def built(self):
        if self._built is None:
            self._built = {}
            for r in self.rows:
                levels = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n].astype(bool) for b, n in zip(r["levels"], r["sizes"], strict=True)]
                extra = {(a, b): c for a, b, c in zip(r["extra"][::3], r["extra"][1::3], r["extra"][2::3], strict=True)}
                self._built[r["shard"]] = (PerfectHash(levels, list(r["ranks"])), np.frombuffer(r["finger"], dtype=np.int64), np.frombuffer(r["keep"], dtype=np.int64), extra)
        return self._built

    def keeper(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in the arrays, and the largest doc_id that holds it."""
        found, keep = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
        shard = (h.view(np.uint64) % np.uint64(self.n_shards)).astype(np.int64)
        for s, (perfect, finger, holder, extra) in self.built().items():
            mine = np.flatnonzero(shard == s)
            if not len(mine):
                continue
            at = perfect.index(h[mine].view(np.uint64))
            ok = at >= 0
            ok[ok] = finger[at[ok]] == f[mine[ok]]
            found[mine[ok]], keep[mine[ok]] = True, holder[at[ok]]
            if extra:
                for i in mine[~ok].tolist():
                    if (k := (int(h[i]), int(f[i]))) in extra:
                        found[i], keep[i] = True, extra[k]
        return found, keep


def _hashes(texts: list[bytes | None], least: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Both halves of each long line's hash, its row and its number in the text."""
    h, f, row, at = [], [], [], []
    for i, text in enumerate(texts):
        _, numbers, keys = long_keys(text, least)
        for k in keys:
            x = xxhash.xxh3_128_intdigest(k)
            h.append(x >> 64)
            f.append(x & 0xFFFFFFFFFFFFFFFF)
        row += [i] * len(keys)
        at += numbers
    return np.array(h, dtype=np.uint64).view(np.int64), np.array(f, dtype=np.uint64).view(np.int64), row, at


def _without(batch: pa.RecordBatch, texts: list[bytes | None], gone: list[set[int]], carry: list[str]) -> pa.RecordBatch:
    total, out = [], []
    for text, g in zip(texts, gone, strict=True):
        lines = (text or b"").split(b"\n")
        total.append(len(lines))
        out.append((b"\n".join(x for i, x in enumerate(lines) if i not in g) if g else text or b"").decode())
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), *(batch.column(c) for c in carry), pa.array(total, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(out, pa.string())],
        names=["id", *carry, "n_lines", "n_dropped", "kept"],
    )


def _probe(held, least: int, carry: list[str]):
    """Documents probe the arrays that were broadcast."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: Shards = held.value
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), as_bytes(batch.column("text"))
            gone: list[set[int]] = [set() for _ in texts]
            h, f, row, at = _hashes(texts, least)
            found, keep = shards.keeper(h, f)
            for j in np.flatnonzero(found).tolist():
                if keep[j] != (_NO_ID if ids[row[j]] is None else ids[row[j]]):
                    gone[row[j]].add(at[j])
            yield _without(batch, texts, gone, carry)

    return run


def _requests(least: int, salts: np.ndarray):
    """A row for each long line: its shard, the part of it that answers, document, number and hash."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("th").to_numpy().astype(np.int64)
            h, f, row, at = _hashes(as_bytes(batch.column("text")), least)
            row = np.array(row, dtype=np.int64)
            shard = (h.view(np.uint64) % np.uint64(len(salts))).astype(np.int64)
            salt = (mix(keys[row].view(np.uint64) + mix(ids[row].view(np.uint64))) % salts[shard]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, salt, ids[row], keys[row], at, h, f)], names=["shard", "salt", "doc", "th", "line", "h", "f"])

    return run


_REQUEST = "shard long, salt long, doc long, th long, line long, h long, f long"
_ANSWER = "doc long, th long, line long"


def _answers(n_shards: int):
    """Lines to drop; a shard's arrays come before its lines."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(n_shards, [])
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "doc", "th", "line", "h", "f")}
            arrays = np.flatnonzero(np.asarray(batch.column("finger").is_valid()))
            # from one row of arrays to the next
            for a, b in zip([-1, *arrays.tolist()], [*arrays.tolist(), batch.num_rows], strict=True):
                if a >= 0:
                    shards = Shards(n_shards, batch.slice(a, 1).to_pylist())
                part = {c: v[a + 1 : b].astype(np.int64) for c, v in columns.items()}
                found, keep = shards.keeper(part["h"], part["f"])
                drop = found & (keep != part["doc"])
                yield pa.RecordBatch.from_arrays([pa.array(part[c][drop], pa.int64()) for c in ("doc", "th", "line")], names=["doc", "th", "line"])

    return run


def _apply(carry: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [set(x or ()) for x in batch.column("gone").to_pylist()]
            yield _without(batch, as_bytes(batch.column("text")), gone, carry)

    return run


def _routed(state: DataFrame, shards: DataFrame, parts: DataFrame, n_shards: int, least: int) -> DataFrame:
    """state with `gone`, the numbers of its lines to drop.  Equal rows get equal answers, so that (id, text) is key enough.

    parts: shard, salts.  The driver holds a number for each shard."""
    salts = np.ones(n_shards, dtype=np.uint64)
    for r in parts.toLocalIterator():
        salts[r["shard"]] = r["salts"]
    keyed = state.withColumn("th", text_key()).withColumn("doc", F.coalesce("id", F.lit(_NO_ID)))
    lines = keyed.select("id", "text", "th").mapInArrow(_requests(least, salts), _REQUEST)
    copies = shards.join(parts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    met = copies.withColumn("first", F.lit(0)).unionByName(lines.withColumn("first", F.lit(1)), allowMissingColumns=True)
    # arrays of k lines come with 5 k lines or more of documents, so a batch holds few of them
    met = met.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "first")
    met = met.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("doc", "th", "line", "h", "f")})
    gone = met.mapInArrow(_answers(n_shards), _ANSWER).groupBy("doc", "th").agg(F.collect_set("line").alias("gone"))
    return keyed.join(gone, ["doc", "th"], "left").drop("doc", "th")


def frequent_lines(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """h, f, n, doc: the hashes of all lines held by enough documents, with the largest doc_id."""
    keys = docs.mapInArrow(_list_keys(least_chars), "h long, f long, doc long")
    return keys.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc").alias("doc")).filter(F.col("n") >= least_docs)


def dedup_lines(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 40,
    least_docs: int = 5, shard_lines: int = 1 << 18, group_bytes: int = 64 << 20, part_lines: int = 1 << 22, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: id, carried columns c0, c1, ..., n_lines, n_dropped, kept (the text without the dropped lines)."""
    spark = docs.sparkSession
    own = {f"c{k}": c for k, c in enumerate(carry)}
    state = narrow(docs, id=id_column, **own, text=text_column)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    lines = store(frequent_lines(state.select("id", "text"), least_chars, least_docs), "lines")
    n = lines.count()
    n_shards = max(1, -(-n // shard_lines))
    unsigned = F.pmod(F.conv(F.hex("h"), 16, 10).cast("decimal(20,0)"), F.lit(n_shards)).cast("long")
    lines = lines.withColumn("shard", unsigned)
    shards = lines.groupBy("shard").applyInArrow(_shard, _SHARD)
    out = ", ".join(["id long", *(f"{c} {kinds[c]}" for c in own), "n_lines long, n_dropped long, kept string"])
    if n * _LINE_BYTES > group_bytes:
        parts = lines.groupBy("shard").agg((1 + F.floor(F.sum("n") / part_lines)).cast("long").alias("salts"))
        return _routed(state, store(shards, "shards"), parts, n_shards, least_chars).mapInArrow(_apply(list(own)), out)
    held = spark.sparkContext.broadcast(Shards(n_shards, [r.asDict() for r in shards.toLocalIterator()]))
    return state.mapInArrow(_probe(held, least_chars, list(own)), out)
