"""Near duplicates with null ids and ids of several texts."""

import pytest

from webdistill.llm import jaccard

from . import brute
from .conftest import prose, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    a, b, c, d, e, f = (prose(60, 100 + i) for i in range(6))
    rows = [(None, a), (1, a), (None, b), (2, b + " tail"), (None, c), (3, d), (3, e), (3, f), (3, f), (4, e), (5, ""), (6, None), (None, "one"), (7, "one two")]
    return rows, spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_one_row_of_each_group_stays(spark, odd):
    import corpus_pipeline as pipeline

    rows, docs = odd
    # each row its own vertex: the brute force with ids that tell rows apart, null first
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    kept = {component for _, _, component in brute.op3([(n, rows[k][1]) for n, k in enumerate(order)], 4, 5, 5)}
    found = pipeline.stage_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    same(found, [rows[order[n]] for n in kept])


def test_near_copies_of_five_words(spark):
    """Copies with an added notice or a few changed words, about the similarity of the stage."""
    import corpus_pipeline as pipeline

    rows = []
    for k in range(6):
        base = prose(100, 500 + k).split(" ")
        for extra in (0, 12, 20, 23, 24, 25, 30):
            rows.append((len(rows), " ".join(base) + "".join(f" x{i}" for i in range(extra))))
        for step in (18, 25, 40, 60):
            rows.append((len(rows), " ".join(f"y{i}" if i % step == 7 else w for i, w in enumerate(base))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {(c,) for _, _, c in brute.op3(rows, 4, 5, 5)}
    assert 6 < len(kept) < len(rows)
    same(pipeline.stage_near_duplicates(spark, docs, "").select("doc_id").collect(), kept)


def test_all_texts_of_an_id_are_one_vertex(odd):
    rows, docs = odd
    rows = [(-1 if i is None else i, t) for i, t in rows]
    found = jaccard.jaccard_components(docs.fillna(-1, ["doc_id"])).select("id", "n_shingles", "component_id").collect()
    same(found, brute.op3([(i, t) for i, t in rows]))


def test_many_texts_of_an_id(spark):
    rows = [(9, prose(40, 300 + i)) for i in range(7)] + [(i, prose(40, 300 + i)) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.jaccard_components(df).select("id", "n_shingles", "component_id").collect(), brute.op3(rows))
