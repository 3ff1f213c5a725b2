"""Operators 2, 3, 6 and 7 against brute force, on hazards and on a whole small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webdistill.llm import entry, jaccard, linedup, passages, substrings
from webdistill.llm.repeats import merge
from webdistill.llm.suffixes import sort_suffixes, suffix_array, suffix_arrays

from . import brute
from .conftest import same


def digest2(df):
    return df.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()


def digest6(df):
    return df.select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()


def digest7(df):
    return df.select("id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()


def test_suffix_arrays():
    r = random.Random(3)
    for _ in range(200):
        strings = []
        for _ in range(r.randint(1, 10)):
            s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 30))]
            strings.append(s * r.randint(1, 3) + [0])
        text = np.array(sum(strings, []), dtype=np.int64)
        got, at = suffix_arrays(text, np.array([len(s) for s in strings])), 0
        for s in strings:
            expected = sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023
            assert suffix_array(s) == expected
            assert (got[at : at + len(s)] - at).tolist() == expected
            at += len(s)


@pytest.mark.parametrize("width", [1, 10**9])
def test_sort_suffixes(width):
    r = random.Random(4)
    strings = [np.array([r.randint(1, 3) for _ in range(r.randint(0, 50))] + [0]) for _ in range(40)]
    text, sa, order = sort_suffixes(strings, width)
    at = 0
    for i in order:
        s = strings[i].tolist()
        assert (sa[at : at + len(s)] - at).tolist() == sorted(range(len(s)), key=lambda k: s[k:])  # noqa: B023
        at += len(s)


def test_merge():
    lo, hi = merge(np.array([5, 0, 2, 9]), np.array([7, 2, 4, 10]))
    assert (lo.tolist(), hi.tolist()) == ([0, 5, 9], [4, 7, 10])


def test_substrings(docs, rows):
    same(digest2(substrings.dedup_substrings(docs)), brute.op2(rows))


def test_substrings_dealt_over_many_strings(docs, rows):
    """Blocks of one anchor in different strings find each other by fingerprint."""
    same(digest2(substrings.dedup_substrings(docs, length=30, gram=8, string_blocks=2)), brute.op2(rows, 30))


def test_passages(docs, rows):
    same(digest6(passages.dedup_passages(docs)), brute.op6(rows))


@pytest.mark.parametrize("batches", [1, 3])
def test_passages_short_windows(docs, rows, batches):
    same(digest6(passages.dedup_passages(docs, window=5, gram=2, batches=batches)), brute.op6(rows, 5))


def test_index(spark):
    from webdistill.llm.common import Workspace

    batch = lambda *x: spark.createDataFrame([(a, b, 1) for a, b in x], "fp long, chk long, n long")
    index = passages.FingerprintIndex(Workspace(spark), "t", fan=2)
    told = lambda: {tuple(r) for r in index.repeated().collect()}
    index.append(batch((1, 1), (1, 1), (2, 2)))
    assert told() == {(1, 1)}
    index.append(batch((2, 2), (2, 3), (4, 4), (5, 5), (5, 5)))
    assert told() == {(2, 2), (5, 5)}
    index.append(batch((1, 1), (2, 3)))
    assert told() == {(1, 1), (2, 3)} and len(index.runs) == 3
    index.append(batch((4, 4), (6, 6)))
    assert told() == {(4, 4)} and len(index.runs) == 2
    assert {(r.fp, r.chk): r.n for r in index.compact().collect()} == {(1, 1): 3, (2, 2): 2, (2, 3): 2, (4, 4): 2, (5, 5): 2, (6, 6): 1}
    assert len(index.runs) == 1


@pytest.mark.parametrize("by", [("fp",), ("fp", "chk")])
def test_runs_are_merge_joined_without_exchange(spark, by):
    from webdistill.llm.common import Workspace

    index = passages.FingerprintIndex(Workspace(spark), "t", by=by)
    for k in range(2):
        index.append(spark.range(50).selectExpr("id % 20 fp", f"id + {k} chk", "1L n").select(*by, "n"))
    plan = index.repeated()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and len(index.runs) == 2


def test_ingest_batch_by_batch(spark, rows):
    """Each batch loses what it shares with itself or any earlier batch; compaction changes nothing."""
    from webdistill.llm.common import Workspace

    index, history = passages.FingerprintIndex(Workspace(spark), "i"), []
    for k in range(3):
        batch = [r for i, r in enumerate(rows) if i % 3 == k and len(r[1] or "") < 100_000]
        found = passages.ingest(spark.createDataFrame(batch, "doc_id long, text string"), index, window=6)
        expected = brute.op6([*history, *batch], 6)
        same(digest6(found), expected[len(history) :])
        history += batch
        if k == 1:
            index.compact()


def test_lines(docs, rows):
    same(digest7(linedup.dedup_lines(docs)), brute.op7(rows))


def test_lines_many_shards(docs, rows):
    """Arrays beyond the bound of a broadcast: lines go to the shards, and their numbers come back."""
    found = linedup.dedup_lines(docs, least_chars=3, least_docs=2, shard_lines=40, group_bytes=1)
    same(digest7(found), brute.op7(rows, 3, 2))


def test_lines_hot_shards(spark, docs, rows):
    """Shards in many parts; rows that share an id, or have none, keep their own lines; nothing frequent at all."""
    found = linedup.dedup_lines(docs, least_chars=3, least_docs=2, shard_lines=7, group_bytes=0, part_lines=2)
    same(digest7(found), brute.op7(rows, 3, 2))
    odd = [(None, "aaaa\nbbbb"), (None, "aaaa\ncccc"), (7, "aaaa\ndddd"), (7, "bbbb\ndddd"), (7, "bbbb\ndddd"), (3, None), (3, ""), (9, "dddd\n\ndddd")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    routed = linedup.dedup_lines(docs, least_chars=3, least_docs=2, shard_lines=1, group_bytes=0, part_lines=1)
    assert "finger" in routed._jdf.queryExecution().analyzed().toString()
    same(digest7(routed), digest7(linedup.dedup_lines(docs, least_chars=3, least_docs=2)))
    same(digest7(linedup.dedup_lines(docs.limit(0), group_bytes=0)), [])


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    built = linedup.PerfectHash.build(keys)
    assert sorted(built.index(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("frequent", [None, 3])
def test_jaccard(docs, rows, frequent):
    found = jaccard.jaccard_components(docs, frequent=frequent).select("id", "n_shingles", "component_id").collect()
    same(found, brute.op3(rows))


@pytest.mark.parametrize("frequent", [0, None])
def test_jaccard_near_copies(spark, frequent):
    """Families of near copies at many distances: every link round the threshold counts."""
    r = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{r.randint(0, 200)}" for _ in range(r.choice([9, 12, 25, 45, 60, 130, 420]))]
        for _ in range(9):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"v{r.randint(0, 9)}"
            if r.random() < 0.5:
                copy += [f"u{r.randint(0, 50)}" for _ in range(r.randint(0, len(base) // 12 + 1))]
            rows.append((len(rows), " ".join(copy)))
        assert family >= 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.jaccard_components(df, frequent=frequent).select("id", "n_shingles", "component_id").collect(), brute.op3(rows))


def test_signatures_share_a_key():
    """Any two sets that reach the similarity share a key of the smaller one's short prefix."""
    r = np.random.default_rng(2)
    for trial in range(300):
        n = int(r.integers(9, 90))
        base = r.choice(2000, n, replace=False).astype(np.uint64) + np.uint64(1 << 40) * r.integers(0, 64, n).astype(np.uint64)
        count = lambda t: (t & np.uint64(2047)).astype(np.int64) % 50
        k = int(r.integers(0, n // 10 + 1))
        other = np.concatenate([base[k:], (np.arange(int(r.integers(0, n // 10 + 1))) + 5000).astype(np.uint64)])
        a, b = (base, other) if len(base) <= len(other) else (other, base)
        inter = len(np.intersect1d(a, b))
        if 19 * inter < 9 * (len(a) + len(b)):
            continue
        for frequent in (0, 20, 60):
            x, y = (jaccard.signatures(np.unique(t), count(np.unique(t)), frequent, 9, 10) for t in (a, b))
            assert set(x[0][x[2]].tolist()) & set(y[0].tolist()), (trial, frequent)


def test_empty(empty):
    assert substrings.dedup_substrings(empty).count() == 0
    assert passages.dedup_passages(empty).count() == 0
    assert linedup.dedup_lines(empty).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0


def test_queries_on_a_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(entry.op3_jaccard(spark, sf).collect(), brute.op3(rows))
    same(entry.op6_passages(spark, sf).collect(), brute.op6(rows))
    same(entry.op7_linedup(spark, sf).collect(), brute.op7(rows))
    short = [(d, t) for d, t in rows if len(t) < 2500][:60]
    few = spark.createDataFrame(short, "doc_id long, text string")
    same(digest2(substrings.dedup_substrings(few)), brute.op2(short))
