"""Operator 9, quality rules: base rules and robust multivariate outliers.

Every document becomes a vector of transformed statistics.  For each language and source the minimum
covariance determinant gives a centre and a scatter that a minority of odd documents can't move, and
documents far from it in Mahalanobis distance are rejected.

The estimate is fully distributed.  Concentration steps start from four first estimates: the h nearest
documents of each group give the next mean and covariance, whose determinant never grows.  After two steps
the start of least determinant goes on until it settles.  Sums are gathered by bins of distance, so a step
is one aggregation with map-side combination over all documents, and a source that holds a third of all
rows is no special case.  Groups are rows of a table, never collected; groups of fewer than
``least_group`` documents are pooled by language, then over all, and a pool that is still too small rejects
nothing.  Estimates are written to the shared folder after each step.

A document goes beyond the distance that one of 10^8 normal ones would exceed (``false_rejections``, a
quantile of chi-squared with as many degrees of freedom as dimensions).  Deviations have floors, as many statistics
are constant in most documents of a source.  They let any one dimension reject but the share of repeated
words, which the base rules judge.

Defined cases: null or empty text has no words and fails the base rules.  Null language or source is a
value like any other.  Repeated rows are judged alike.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, narrow, store, tidy, views
from .repeats import SPACE, Windows, mix, word_spans, word_units

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Dimensions of the vector and the least standard deviation of each: many statistics are constant in
#: most documents of a source, and a zero variance would reject all others.
DIMS, FLOORS = ("x0", "x1", "x2", "x3", "x4"), (0.5, 0.6, 0.35, 0.14, 0.2)
P = len(DIMS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_BIN = 64.0


def chi2_quantile(beyond: float) -> float:
    """What chi-squared with five degrees of freedom exceeds with the chance `beyond`."""
    above = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > beyond else (low, mid)
    return high


def _text_stats(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """STATS of each text, one row a text."""
    n = len(bounds) - 1
    out = np.zeros((n, len(STATS)), dtype=np.int64)
    start, end, words = word_spans(raw, bounds)
    out[:, 0] = np.diff(words)
    head = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & ~SPACE[raw])])
    out[:, 1] = np.diff(head[bounds])
    out[:, 2] = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[raw])])[bounds])
    out[:, 5] = np.diff(np.concatenate([[0], np.cumsum(raw == 10)])[bounds]) + 1
    blanks = BLANKS.encode()
    blob = raw.tobytes()
    for i in np.flatnonzero(out[:, 5] > 1).tolist():
        lines = [x for x in blob[bounds[i] : bounds[i + 1]].split(b"\n") if x.strip(blanks)]
        out[i, 3] = len(lines) - len(set(lines))
    size = 8
    if len(start) >= size:
        grams = Windows(word_units(raw, start, end), size).all(size)
        at = np.arange(len(grams))
        text = np.searchsorted(words, at, side="right") - 1
        ok = at + size <= words[text + 1]
        at, text = at[ok], text[ok]
        keyed = mix(grams[at] ^ mix(text.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keyed, kind="stable")
        k = keyed[order]
        equal = k[1:] == k[:-1]
        twice = np.zeros(len(k), dtype=bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        cover = np.zeros(len(start) + 1, dtype=np.int64)
        hit = at[order[twice]]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        out[:, 4] = np.diff(covered[words])
    return out


@tidy
def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"] + (["text"] if "keep_text" in batch.schema.names else [])
        rest = [c for c in rest if c != "keep_text"]
        for i, j, raw, bounds in views(batch.column("text")):
            part = batch.slice(i, j - i)
            found = _text_stats(raw, bounds)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in rest] + [pa.array(found[:, k]) for k in range(len(STATS))], names=[*rest, *STATS]
            )


def statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs(id, lang, source, text) with the statistics, and with the text if asked for."""
    if keep_text:
        docs = docs.withColumn("keep_text", F.lit(True))
    kinds = ["id long", "lang string", "source string"] + ["text string"] * keep_text + [f"{c} long" for c in STATS]
    return docs.mapInArrow(_stats, ", ".join(kinds))


def vector(n_words="n_words") -> list[Column]:
    n = F.greatest(F.col(n_words), F.lit(1)).cast("double")
    return [
        F.log1p(n),
        F.col("word_chars") / n,
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _groups(found: DataFrame, least: int) -> DataFrame:
    """lang, source, grp: the group that each language and source belongs to."""
    n = found.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.to_json(F.struct("lang", "source"))
    pool = F.to_json(F.struct("lang", F.lit("*").alias("pool")))
    small = n.filter(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("rest")).withColumnRenamed("lang", "lang2")
    return n.join(small, n["lang"].eqNullSafe(small["lang2"]), "left").select(
        "lang", "source",
        F.when(F.col("n") >= least, own).when(F.col("rest") >= least, pool).otherwise(F.lit("all")).alias("grp"),
    )


def _with_groups(found: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[c for c in groups.columns if c not in ("lang", "source")])
    return found.join(g, found["lang"].eqNullSafe(g["g_lang"]) & found["source"].eqNullSafe(g["g_source"]), "left").drop("g_lang", "g_source")


def _moments(weight: Column | None = None) -> list[Column]:
    """k, s0.., q00..: the weight of a set of rows, and its weighted sums and products."""
    w = F.lit(1.0) if weight is None else weight
    return [
        F.sum(w).alias("k"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(DIMS)],
        *[F.sum(w * F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i, j in PAIRS],
    ]


_SUMS = ["k", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
_ESTIMATE = ", ".join(["grp string", "start int", "n long", "logdet double", *[f"m{i} double" for i in range(P)], *[f"p{i}{j} double" for i, j in PAIRS]])


def _invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(grp, start, n, sums) to mean, inverse covariance and the logarithm of its determinant."""
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            k = max(r.k, 1e-9)
            mean = np.array([getattr(r, f"s{i}") for i in range(P)]) / k
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = getattr(r, f"q{i}{j}") / k - mean[i] * mean[j]
            logdet, precision = _precision(cov)
            rows.append((r.grp, r.start, r.n, logdet, *mean, *precision))
        yield pd.DataFrame(rows, columns=["grp", "start", "n", "logdet", *[f"m{i}" for i in range(P)], *[f"p{i}{j}" for i, j in PAIRS]])


def _precision(cov: np.ndarray) -> tuple[float, list[float]]:
    """Log-determinant and inverse after lifting each deviation to its floor."""
    floor = np.array(FLOORS) ** 2
    lift = np.maximum(floor - np.diag(cov), 0.0)
    full = cov + np.diag(lift) + np.diag(floor * 1e-3)
    inv = np.linalg.inv(full)
    return float(np.linalg.slogdet(full)[1]), [float(inv[i, j]) for i, j in PAIRS]


def distance() -> Column:
    """Squared Mahalanobis distance of DIMS from the joined estimate."""
    d = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(DIMS)]
    return reduce(lambda a, b: a + b, ((1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * d[i] * d[j] for i, j in PAIRS))


def _starts(x: DataFrame) -> DataFrame:
    """First estimates of each group: medians and quartile ranges, all its rows, and two pseudo-random quarters."""
    long = x.select("grp", F.posexplode(F.array(*DIMS)).alias("d", "v"))
    counts = long.groupBy("grp", "d", F.floor(F.col("v") * 256).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp", "d")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    wide = ranked.groupBy("grp", "d").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"), F.max("all").alias("n"))
    sums = wide.groupBy("grp").agg(
        F.max("n").alias("n"), F.lit(1.0).alias("k"),
        *[F.max(F.when(F.col("d") == i, (F.col("b") + 0.5) / 256)).alias(f"s{i}") for i in range(P)],
        *[F.max(F.when(F.col("d") == i, F.pow((F.col("c") - F.col("a")) / (256 * 1.349), 2))).alias(f"v{i}") for i in range(P)],
    )
    medians = sums.select("grp", F.lit(0).alias("start"), "n", "k", *[f"s{i}" for i in range(P)], *[((F.col(f"v{i}") if i == j else F.lit(0.0)) + F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}{j}") for i, j in PAIRS])
    quarter = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), *DIMS), F.lit(4)) == 0).cast("double")
    means = x.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), w.alias("w")) for k, w in ((1, F.lit(1.0)), (2, quarter(2)), (3, quarter(3)))])).alias("of"))
    means = means.groupBy("grp", F.col("of.start").alias("start")).agg(F.count("*").alias("n"), *_moments(F.col("of.w"))).filter("k > 0")
    return medians.unionByName(means).mapInPandas(_invert, _ESTIMATE)


def _concentrate(x: DataFrame, estimate: DataFrame, support: float) -> DataFrame:
    """One concentration step: mean and covariance of the h nearest rows of each group, for each of its starts.

    h is the ceiling of `support` times the group's rows.  Distances are summed in bins of 1.6 percent; the rows of
    the bin that holds the h-th, ties among them, share what is left of h.
    """
    d = x.join(estimate, "grp").withColumn("bin", F.floor(F.log1p(F.greatest(distance(), F.lit(0.0))) * _BIN))
    bins = d.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *_moments())
    w = Window.partitionBy("grp", "start")
    bins = bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    share = F.least((F.ceil(F.lit(support) * F.col("all")) - F.col("before")) / F.col("n"), F.lit(1.0))
    near = bins.withColumn("share", share).filter("share > 0")
    return near.groupBy("grp", "start").agg(F.max("all").alias("n"), *[F.sum(F.col("share") * F.col(c)).alias(c) for c in _SUMS]).mapInPandas(_invert, _ESTIMATE)


def _least(estimate: DataFrame) -> DataFrame:
    """The start of least determinant of each group; the first of equals."""
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    return estimate.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def estimate_groups(x: DataFrame, support: float = 0.75, tries: int = 2, most_steps: int = 30, settled: float = 1e-3) -> DataFrame:
    """x(grp, *DIMS) to the minimum-determinant estimate of each group.

    All starts take `tries` concentration steps; the one of least determinant goes on until no group's
    log-determinant falls by more than `settled`.
    """
    estimate = store(_starts(x), "estimate")
    for _ in range(tries):
        estimate = store(_concentrate(x, estimate, support), "estimate")
    estimate = store(_least(estimate), "estimate")
    for _ in range(most_steps):
        new = store(_concentrate(x, estimate, support), "estimate")
        before = estimate.select("grp", F.col("logdet").alias("before"))
        both = new.join(before, "grp")
        # a step that doesn't lower the determinant isn't taken
        fell = both.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        if fell is None or fell <= settled:
            break
        estimate = new
    return estimate


def fit(docs: DataFrame, *, support: float = 0.75, least_group: int = 50) -> DataFrame:
    """docs(id, lang, source, text) to lang, source, grp, mean, precision and scale of every group."""
    found = statistics(docs).filter(~base_failed())
    found = found.select("lang", "source", *[c.alias(d) for c, d in zip(vector(), DIMS, strict=True)])
    found = store(found, "statistics")
    groups = store(_groups(found, least_group), "groups")
    x = _with_groups(found, groups).drop("lang", "source")
    estimate = estimate_groups(x, support)
    # the median distance of a group is that of normal data, or more
    bins = x.join(estimate, "grp").groupBy("grp", F.floor(F.log1p(F.greatest(distance(), F.lit(0.0))) * _BIN).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")
    upto = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w)).filter("2 * upto >= all")
    scale = upto.groupBy("grp").agg(F.greatest(F.expm1((F.min("bin") + 1) / _BIN) / chi2_quantile(0.5), F.lit(1.0)).alias("scale"))
    return store(groups.join(estimate.drop("start"), "grp").join(scale, "grp"), "model")


def judge(docs: DataFrame, model: DataFrame, *, false_rejections: float = 1e-8, least_group: int = 50, keep_text: bool = False) -> DataFrame:
    """Each document with its statistics, base_failed, distance (null without a group) and kept."""
    found = statistics(docs, keep_text)
    found = found.select("*", *[c.alias(d) for c, d in zip(vector(), DIMS, strict=True)])
    placed = _with_groups(found, model)
    far = distance() / F.col("scale")
    out = [c for c in found.columns if c not in DIMS]
    return placed.select(
        *out, base_failed().alias("base_failed"), F.when(F.col("n") >= least_group, far).alias("distance")
    ).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_quantile(false_rejections)))


def quality_rules(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    source_column: str = "source", false_rejections: float = 1e-8, keep_text: bool = False,
) -> DataFrame:
    """Fit on all documents, then judge all: id, lang, source, statistics, base_failed, distance, kept."""
    rows = narrow(docs, id=id_column, lang=lang_column, source=source_column, text=text_column)
    return judge(rows, fit(rows), false_rejections=false_rejections, keep_text=keep_text)
