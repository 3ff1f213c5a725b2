"""Operator 6, substring dedup over words: a log-structured fingerprint index.

An index holds sorted immutable runs of fingerprints and their counts.  Each batch of documents adds one
run: its fingerprints, counted, dealt to buckets by hash and sorted.  A new run is merge-joined with each
earlier one, bucket by bucket without an exchange; runs are merged by compaction once there are more than
``fan``.  A fingerprint is believed only together with its check, another hash of the same words
(``repeats``), by which every match is verified.

Windows are indexed in two levels, so that a batch need not list each of its windows.  Windows that
share their smallest gram, their anchor, form a block (see ``repeats``).  The first level indexes anchors
and blocks.  A block found again as a whole is repeated in all its windows; a block whose anchor never
recurs holds no repeated window; what is left, blocks that share an anchor but not their whole content (the edges of
repeated passages), is opened into single windows, which the second level indexes.

No step needs the rows of a key in one task: counting combines map-side, joins are plain equi-joins
whose skewed partitions Spark splits, and only a document's own spans are gathered, as a set.

Defined cases: null or empty text has no words and keeps nothing.  Repeated rows are copies like any
others: their windows count as found elsewhere.  Rows with equal id and text get equal results.  Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, narrow, text_key, tidy, views
from .repeats import Windows, merge, mix, text_blocks, word_spans, word_units

BLOCK_ROWS = "fp long, chk long, id long, th long, first int, last int"


def keyed(docs: DataFrame) -> DataFrame:
    """docs(id, text) with a key of the text, so that rows with equal id and other text stay apart."""
    return docs.select("id", text_key().alias("th"), "text")


def list_blocks(unit: str, length: int, gram: int):
    """The blocks of every text as rows of BLOCK_ROWS; first and last are the block's window starts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in views(batch.column("text")):
                ids, keys = batch.column("id").slice(i, j - i), batch.column("th").slice(i, j - i)
                for anchor, body, text, first, last in text_blocks(raw, bounds, unit, length, gram):
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), ids.take(at), keys.take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                        names=["fp", "chk", "id", "th", "first", "last"],
                    )

    return run


class FingerprintIndex:
    """Sorted immutable runs of (*by, n) in the shared folder, one row a key, in buckets by key."""

    def __init__(self, space: Workspace, name: str, by: tuple[str, ...] = ("fp", "chk"), fan: int = 4):
        self.space, self.name, self.by, self.fan, self.runs = space, name, by, fan, []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return self.space.store_sorted(rows.groupBy(*self.by).agg(F.sum("n").alias("n")), self.name, self.by)

    def append(self, batch: DataFrame) -> DataFrame:
        """batch(*by, n): adds one sorted run, and merges the earlier ones first if there are too many."""
        if len(self.runs) > self.fan:
            self.compact()
        self.runs.append(self._sorted(batch))
        return self.runs[-1]

    def repeated(self) -> DataFrame:
        """Keys of the newest run that stand in it more than once or in an earlier run; a key may come more than once."""
        new = self.runs[-1]
        out = new.filter("n > 1").select(*self.by)
        for r in self.runs[:-1]:
            out = out.unionAll(new.select(*self.by).join(r.select(*self.by).hint("merge"), list(self.by), "left_semi"))
        return out

    def all(self) -> DataFrame:
        out = self.space.unsorted(self.runs[0])
        for r in self.runs[1:]:
            out = out.unionByName(self.space.unsorted(r))
        return out

    def compact(self, keep: DataFrame | None = None) -> DataFrame:
        """Merge all runs into one sorted run; with `keep`(fp), only those fingerprints.

        Returned as plain rows: what is joined with them is dealt anew, so that skewed keys can be split.
        """
        rows = self.all() if keep is None else self.all().join(keep.hint("merge"), "fp", "left_semi")
        old, self.runs = self.runs, [self._sorted(rows)]
        for r in old:
            self.space.drop(r)
        return self.all()


def repeated_blocks(space: Workspace, docs: DataFrame, unit: str, length: int, gram: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """First level over docs(id, th, text), a batch after the other: covered spans and open blocks.

    Each batch is looked up in the runs of the batches before it; anchors met twice are kept, and the last
    compaction leaves their blocks only.

    spans(id, th, lo, hi): blocks found again as a whole.
    open(fp, chk, n, id, th, first, last): one row for each distinct block whose anchor recurs with
    other content, n times in all.
    """
    anchors, index = FingerprintIndex(space, "anchors", by=("fp",)), FingerprintIndex(space, "blocks")
    listed = lambda d: d.mapInArrow(list_blocks(unit, length, gram), BLOCK_ROWS)
    met = []
    for b in range(batches):
        part = docs if batches == 1 else docs.filter(F.pmod(F.xxhash64("id", "th"), F.lit(batches)) == b)
        run = index.append(listed(part).select("fp", "chk", F.lit(1).alias("n")))
        anchors.append(run.select("fp", "n"))
        met.append(space.store(anchors.repeated(), "met"))
    twice = met[0]
    for m in met[1:]:
        twice = twice.unionAll(m)
    kinds = index.compact(twice.distinct())
    for m in met + anchors.runs:
        space.drop(m)
    found = space.store(listed(docs).join(kinds.hint("merge"), ["fp", "chk"]), "found")
    mixed = space.store(kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("fp"), "mixed")
    spans = found.filter("n > 1").select("id", "th", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    where = F.struct("id", "th", "first", "last")
    # one row a block before the join, so that copies of a common block never meet; an inner join, since
    # Catalyst would move a semi-join below the aggregation
    some = found.groupBy("fp", "chk").agg(F.max("n").alias("n"), F.min(where).alias("at"))
    return spans, space.store(some.join(mixed.hint("merge"), "fp").select("fp", "chk", "n", "at.*"), "open")


def by_document(rows: DataFrame, docs: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """docs(id, th, text) with `rows`, the set of (columns) that belong to each document."""
    lists = rows.groupBy(F.col("id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_set(F.struct(*columns)).alias("rows"))
    return docs.join(lists, docs["th"].eqNullSafe(F.col("r_th")) & docs["id"].eqNullSafe(F.col("r_id")), how).drop("r_id", "r_th")


def _open_windows(length: int):
    """Every window of a document's open blocks."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in views(batch.column("text")):
                start, end, words = word_spans(raw, bounds)
                hashes = [Windows(word_units(raw, start, end, w), length, w) for w in (0, 1)]
                ids, keys = batch.column("id").slice(i, j - i), batch.column("th").slice(i, j - i)
                text, first, last, weight = [], [], [], []
                for k, blocks in enumerate(batch.column("rows").slice(i, j - i).to_pylist()):
                    for b in blocks:
                        text.append(k)
                        first.append(b["first"])
                        last.append(b["last"])
                        weight.append(b["n"])
                if not text:
                    continue
                size = np.array(last) - np.array(first) + 1
                which = np.repeat(np.arange(len(text)), size)
                own = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.array(first)[which]
                doc = np.array(text)[which]
                at = own + words[doc]
                out = [mix(h.of(at, length)).view(np.int64) for h in hashes]
                d = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0]), pa.array(out[1]), pa.array(np.array(weight, dtype=np.int64)[which]), ids.take(d), keys.take(d), pa.array(own.astype(np.int32))],
                    names=["fp", "chk", "n", "id", "th", "at"],
                )

    return run


def _all_windows(length: int):
    """Every window of every document, as rows for an index."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in views(batch.column("text")):
                start, end, words = word_spans(raw, bounds)
                size = np.maximum(np.diff(words) - length + 1, 0)
                doc = np.repeat(np.arange(j - i), size)
                own = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                at = own + words[doc]
                hashes = [Windows(word_units(raw, start, end, w), length, w) for w in (0, 1)]
                d = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(mix(h.of(at, length)).view(np.int64)) for h in hashes), pa.array(np.ones(len(doc), dtype=np.int64)), batch.column("id").slice(i, j - i).take(d), batch.column("th").slice(i, j - i).take(d), pa.array(own.astype(np.int32))],
                    names=["fp", "chk", "n", "id", "th", "at"],
                )

    return run


@tidy
def _keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, kept = [], [], []
        for raw, spans in zip(as_bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True):
            words = (raw or b"").split()
            total.append(len(words))
            lo, hi = merge(np.array([s["lo"] for s in spans or ()], dtype=np.int64), np.array([s["hi"] for s in spans or ()], dtype=np.int64))
            gone.append(int((hi - lo).sum()))
            for a, b in zip(lo[::-1].tolist(), hi[::-1].tolist(), strict=True):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def dedup_passages(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = 35, gram: int = 8, batches: int = 2,
) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    space = Workspace(docs.sparkSession)
    rows = keyed(narrow(docs, id=id_column, text=text_column))
    spans, opened = repeated_blocks(space, rows, "word", window, gram, batches)
    index = FingerprintIndex(space, "windows")
    windows = by_document(opened, rows, "first", "last", "n").mapInArrow(_open_windows(window), "fp long, chk long, n long, id long, th long, at int")
    windows = space.store(windows, "opened")
    index.append(windows.select("fp", "chk", "n"))
    twice = index.all().filter("n > 1").select("fp", "chk")
    # blocks that were found again as a whole are covered already
    edges = windows.filter("n = 1").join(twice.hint("merge"), ["fp", "chk"], "left_semi").select("id", "th", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    spans = space.store(spans.unionByName(edges), "spans")
    space.keep(spans)
    return by_document(spans, rows, "lo", "hi", how="left").mapInArrow(_keep_words, "id long, n_words long, n_removed long, kept string")


def ingest(docs: DataFrame, index: FingerprintIndex, *, id_column: str = "doc_id", text_column: str = "text", window: int = 35) -> DataFrame:
    """A new batch against history: as dedup_passages, with every window that an earlier batch holds, or that
    the batch holds twice, counting as repeated.  Afterwards the index has one more run; what earlier
    batches kept stays as it is.
    """
    space = index.space
    rows = keyed(narrow(docs, id=id_column, text=text_column))
    windows = space.store(rows.mapInArrow(_all_windows(window), "fp long, chk long, n long, id long, th long, at int"), "new")
    index.append(windows.select("fp", "chk", "n"))
    known = space.store(index.repeated(), "known")
    hit = windows.join(known.hint("merge"), ["fp", "chk"], "left_semi").select("id", "th", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    return by_document(hit, rows, "lo", "hi", how="left").mapInArrow(_keep_words, "id long, n_words long, n_removed long, kept string")
