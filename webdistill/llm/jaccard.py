"""Operator 3, n-gram Jaccard join with token-combination prefixes.

A document is its set of 3-word shingles.  All shingles have one order, rare before frequent, and two
classes.  A document's prefix grows along the order until it *covers* more tokens than a partner may
lack: a rare token covers one; frequent tokens are dealt to subclasses, and m tokens of a subclass cover
m - 1, because losing m - 1 of them breaks its last pair.  Rare tokens of the prefix are indexed alone,
frequent ones as pairs within their subclass.  Two sets that reach the similarity share an index key,
one of the smaller set's shorter prefix; no threshold, cap or sample decides what is compared.

The order comes from a count sketch over all documents (fixed size, summed block-wise), so that it is
the same everywhere and bounded; it decides how much is compared, never what is found.

Equal sets are one class from the start.  Keys that only one class has, or none in its short prefix, are
dropped.  Tokens before the first shared key are not shared, which bounds the overlap.  Candidates are
compared in two rounds: first each class with one member of each of its keys (that with the fewest
tokens before it), which joins most groups of copies with one comparison a member; then, in keys whose members still belong
to different components, all members of different components.  Every candidate pair is either compared
exactly or already connected.  Components are found by alternating star steps on tables.

Defined cases: null or empty text, or text without words, is an empty set linked with nothing.  Fewer
than three words are one shingle.  Rows that share a doc_id are one vertex; repeated rows are equal
sets.  A null doc_id is a vertex below all others.  Empty tables give no rows.  Shingles and sets are
told apart by 64-bit hashes that are not linear (``repeats``): some two of n different sets meet falsely
with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, narrow, tidy, views
from .passages import keyed
from .repeats import Windows, mix, pair, word_spans, word_units

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NO_ID = -(1 << 63)

CELLS, BLOCKS = 1 << 20, 64
#: (least set size, subclasses of frequent tokens): a set also follows the neighbouring regime where a
#: partner's size may.
REGIMES = ((0, 1), (40, 4), (400, 16), (4000, 64))


def token_sets(raw: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    start, end, words = word_spans(raw, bounds)
    units = word_units(_FOLD[raw], start, end)
    grams = mix(Windows(units, size).all(size) + np.uint64(size))
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            whole = units[a : a + 1]
            for i in range(a + 1, b):
                whole = pair(whole, units[i : i + 1])
            yield mix(whole + np.uint64(b - a))
        else:
            yield grams[:0]


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a sorted set."""
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def _classes(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c = [], []
            for _, _, raw, bounds in views(batch.column("text")):
                for t in token_sets(raw, bounds, size):
                    n.append(len(t))
                    c.append(set_key(t) if len(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["id", "th", "n", "c"])

    return run


def _sketch(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, raw, bounds in views(batch.column("text")):
                tokens = np.concatenate([*token_sets(raw, bounds, size), np.zeros(0, dtype=np.uint64)])
                total += np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([x.tobytes() for x in np.split(total, BLOCKS)], pa.binary())], names=["block", "cells"])

    return run


@tidy
def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over the blocks of one partition; memory for one array a block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
            x = np.frombuffer(cells.as_buffer(), dtype=np.int64)
            total[k] = total[k] + x if k in total else x.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "cells"])


def count_sketch(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold a token of each cell; CELLS counts whatever the input's size."""
    kind = "block long, cells binary"
    summed = rows.mapInArrow(_sketch(size), kind).repartition(BLOCKS, "block").mapInArrow(_sum_blocks, kind).collect()
    out = np.zeros(CELLS, dtype=np.int64)
    for r in summed:
        out[r["block"] * (CELLS // BLOCKS) : (r["block"] + 1) * (CELLS // BLOCKS)] = np.frombuffer(r["cells"], dtype=np.int64)
    return out


def regimes_of(n: int, num: int, den: int) -> list[int]:
    """Numbers of subclasses that a set of n tokens follows: those of every size a partner may have."""
    low, high = -(-n * num // den), n * den // num
    return [g for k, (least, g) in enumerate(REGIMES) if high >= least and (k + 1 == len(REGIMES) or low < REGIMES[k + 1][0])]


def _prefix(tokens: np.ndarray, rare: int, lack: int, regimes: list[int]) -> tuple[int, dict[int, int]]:
    """How many rare tokens, and for each number of subclasses how many frequent ones, cover lack + 1."""
    if rare > lack:
        return lack + 1, {}
    rest = tokens[rare:]
    out = {}
    for g in regimes:
        sub = ((rest >> np.uint64(40)) % np.uint64(g)).astype(np.int64)
        # a token covers one unless it is the first of its subclass
        first = np.zeros(len(sub), dtype=np.int64)
        first[np.unique(sub, return_index=True)[1]] = 1
        out[g] = int(np.searchsorted(np.cumsum(1 - first), lack + 1 - rare)) + 1
    return rare, out


def signatures(tokens: np.ndarray, count: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of one set: whether each is a rare token alone (else a pair of frequent ones), whether it
    is in the short prefix, and how many tokens before it no partner can have that is first met here.
    Similarity is num/den.

    A set may lack more of a smaller partner's size than of a larger one's: the smaller set of a pair is
    found by its short prefix, the larger by its long one.
    """
    n = len(tokens)
    order = np.lexsort((tokens, count))
    tokens, count = tokens[order], count[order]
    rare = int(np.searchsorted(count, frequent, side="right"))
    regimes = regimes_of(n, num, den)
    long = _prefix(tokens, rare, n - -(-n * num // den), regimes)
    short = _prefix(tokens, rare, n - -(-2 * num * n // (num + den)), regimes)
    keys, brief, ahead = [tokens[: long[0]]], [np.arange(long[0]) < short[0]], [np.arange(long[0])]
    for g, length in long[1].items():
        head = tokens[rare : rare + length]
        sub = ((head >> np.uint64(40)) % np.uint64(g)).astype(np.int64)
        limit = short[1].get(g, 0)
        fresh = np.zeros(length + 1, dtype=np.int64)
        fresh[np.unique(sub, return_index=True)[1] + 1] = 1
        others = np.cumsum(fresh)  # subclasses among the tokens before each
        for s in np.unique(sub):
            own = np.flatnonzero(sub == s)
            i, j = np.triu_indices(len(own), 1)
            keys.append(mix(mix(head[own[i]] + np.uint64(g)) + head[own[j]]))
            brief.append(own[j] < limit)
            # before the first shared pair, each other subclass may have one shared token, this one none
            ahead.append(rare + own[i] - others[own[i]] + (i > 0))
    alone = np.zeros(sum(map(len, keys)), dtype=bool)
    alone[: long[0]] = True
    return np.concatenate(keys), alone, np.concatenate(brief), np.concatenate(ahead)


def _index(held, size: int, frequent: int, num: int, den: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = held.value
        least = -(-den // (den - num)) - 1  # smaller sets only link with their equals
        for batch in batches:
            for _, _, raw, bounds in views(batch.column("text")):
                keys, c, n = [], [], []
                for t in token_sets(raw, bounds, size):
                    if len(t) < least:
                        continue
                    k = signatures(t, sketch[(t & np.uint64(CELLS - 1)).astype(np.int64)], frequent, num, den)
                    keys.append(k)
                    m = len(k[0])
                    c.append(np.full(m, set_key(t)))
                    n.append(np.full(m, len(t), dtype=np.int32))
                if keys:
                    sig, single, brief, ahead = (np.concatenate(x) for x in zip(*keys, strict=True))
                    columns = (sig.view(np.int64), single, brief, *map(np.concatenate, (c, n)), ahead.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sig", "single", "brief", "c", "n", "ahead"])

    return run


def _sets(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for _, _, raw, bounds in views(batch.column("text")):
                tokens += [t.view(np.int64) for t in token_sets(raw, bounds, size)]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(tokens, pa.list_(pa.int64()))], names=["c", "tokens"])

    return run


def components(space: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) to (c, root): the least vertex of each vertex's component, by alternating stars."""
    e = space.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    for _ in range(most_rounds):
        # large star: every larger neighbour to the least of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = space.store(large, "large")
        # small star: the vertex and its smaller neighbours to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = space.store(moved.filter("a <> b").distinct(), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("c"), F.col("b").alias("root"))


def _may_link(num: int, den: int):
    """Whether x and y, if this is the first key they share, have enough tokens left for the similarity.

    A pair that reaches it passes in the first key that it shares, which is all that is needed.
    """
    most = F.least(F.col("x_n") - F.col("x_ahead"), F.col("y_n") - F.col("y_ahead"))
    return (num + den) * most >= num * (F.col("x_n") + F.col("y_n"))


def _as(side: str, m: DataFrame, *keys: str) -> DataFrame:
    return m.select(*keys, *[F.col(x).alias(f"{side}_{x}") for x in m.columns if x not in keys])


def _linked(space: Workspace, rows: DataFrame, size: int, num: int, den: int, frequent: int | None) -> tuple[DataFrame, DataFrame]:
    """rows(id, text, th) to classes(id, th, n, c) and edges(a, b): enough links of classes for all components."""
    spark = rows.sparkSession
    classes = space.store(rows.mapInArrow(_classes(size), "id long, th long, n long, c long"), "classes")
    sketch = count_sketch(rows, size)
    if frequent is None:
        frequent = max(64, int(8 * sketch.mean()))
    held = spark.sparkContext.broadcast(sketch)
    listed = lambda: rows.mapInArrow(_index(held, size, frequent, num, den), "sig long, single boolean, brief boolean, c long, n int, ahead int")

    shared = listed().groupBy("sig", "single").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("brief").alias("brief")).filter("low <> high and brief")
    shared = space.store(shared.select("sig", "single"), "shared")
    members = space.store(listed().join(shared.hint("merge"), ["sig", "single"], "left_semi").distinct(), "members")

    def compared(pairs: DataFrame) -> DataFrame:
        """pairs(x_c, y_c, total), stored, that reach the similarity."""
        # the text of one document of each class that is compared at all
        wanted = pairs.select(F.col("x_c").alias("c")).union(pairs.select("y_c")).distinct()
        one = classes.join(wanted, "c", "left_semi").groupBy("c").agg(F.min(F.struct("id", "th")).alias("at"))
        one = one.select("c", F.col("at.id").alias("r_id"), F.col("at.th").alias("r_th"))
        picked = rows.join(one, rows["th"].eqNullSafe(F.col("r_th")) & rows["id"].eqNullSafe(F.col("r_id")))
        picked = picked.groupBy("c").agg(F.min("text").alias("text"))
        sets = space.store(picked.mapInArrow(_sets(size), "c long, tokens array<long>"), "sets")
        x = sets.select(F.col("c").alias("x_c"), F.col("tokens").alias("x_tokens"))
        y = sets.select(F.col("c").alias("y_c"), F.col("tokens").alias("y_tokens"))
        both = pairs.join(x, "x_c").join(y, "y_c")
        return both.filter((num + den) * F.size(F.array_intersect("x_tokens", "y_tokens")) >= num * F.col("total")).select("x_c", "y_c")

    total = (F.col("x_n") + F.col("y_n")).alias("total")
    hub = members.groupBy("sig", "single").agg(F.min(F.struct("ahead", "c", "n")).alias("hub"))
    stars = _as("x", members, "sig", "single").join(hub, ["sig", "single"])
    stars = stars.select("*", F.col("hub.ahead").alias("y_ahead"), F.col("hub.c").alias("y_c"), F.col("hub.n").alias("y_n"))
    stars = space.store(stars.filter((F.col("x_c") != F.col("y_c")) & _may_link(num, den)).select("x_c", "y_c", total).distinct(), "stars")
    links = space.store(compared(stars), "links")
    roots = components(space, links.select(F.col("x_c").alias("a"), F.col("y_c").alias("b")))

    placed = members.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    split = placed.groupBy("sig", "single").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("sig", "single")
    placed = space.store(placed.join(split.hint("merge"), ["sig", "single"], "left_semi"), "placed")
    apart = _as("x", placed, "sig", "single").join(
        _as("y", placed, "sig", "single").hint("merge"), ["sig", "single"]
    ).filter((F.col("x_root") != F.col("y_root")) & F.col("y_brief") & (F.struct("x_n", "x_c") > F.struct("y_n", "y_c")) & _may_link(num, den))
    apart = apart.select(F.least("x_c", "y_c").alias("x_c"), F.greatest("x_c", "y_c").alias("y_c"), total).distinct()
    done = stars.select(F.least("x_c", "y_c").alias("d_x"), F.greatest("x_c", "y_c").alias("d_y"))
    apart = apart.join(done, (F.col("x_c") == F.col("d_x")) & (F.col("y_c") == F.col("d_y")), "left_anti")
    more = compared(space.store(apart, "apart"))
    return classes, links.unionByName(space.store(more, "links")).select(F.col("x_c").alias("a"), F.col("y_c").alias("b"))


def jaccard_components(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = 3, num: int = 9, den: int = 10,
    frequent: int | None = None,
) -> DataFrame:
    """One row a document: id, n_shingles, component_id (least id that links reach).  Similarity num/den.

    frequent: tokens in cells with more documents than this are frequent; by default eight times the
    mean cell, and at least 64.
    """
    space = Workspace(docs.sparkSession)
    classes, edges = _linked(space, keyed(narrow(docs, id=id_column, text=text_column)), size, num, den, frequent)
    # rows that share an id are one vertex: each class of an id and its least one
    full = classes.filter("c is not null").select("id", "c")
    many = full.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z").select(F.col("id").alias("m_id"), "a")
    same_id = full.join(many, F.col("id").eqNullSafe(F.col("m_id"))).filter("a <> c").select("a", F.col("c").alias("b")).distinct()
    roots = components(space, edges.unionByName(same_id))

    placed = space.store(classes.join(roots, "c", "left").select("id", "n", F.coalesce("root", "c").alias("root")), "roots")
    least = placed.filter("root is not null").groupBy("root").agg(F.min(F.coalesce("id", F.lit(_NO_ID))).alias("least"))
    out = placed.join(least, "root", "left")
    found = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.nullif("least", F.lit(_NO_ID)))
    return out.select("id", F.col("n").alias("n_shingles"), found.alias("component_id"))


def jaccard_firsts(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = 3, num: int = 9, den: int = 10,
    frequent: int | None = None,
) -> DataFrame:
    """id and text key (common.text_key) of the first row of each group of similar rows, null id first.

    Unlike above a vertex is a row, that is its id and text: rows of one id or without one are linked only by their sets.
    """
    space = Workspace(docs.sparkSession)
    classes, edges = _linked(space, keyed(narrow(docs, id=id_column, text=text_column)), size, num, den, frequent)
    placed = classes.join(components(space, edges), "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = placed.filter("root is not null").groupBy("root").agg(F.min(F.struct("id", "th")).alias("at")).select("at.id", "at.th")
    return first.unionByName(placed.filter("root is null").select("id", "th").distinct())
