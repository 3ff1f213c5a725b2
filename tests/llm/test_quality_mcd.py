"""Operator 9: the estimate against brute force, the verdict of each kind of group, and what each dimension may reject."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webdistill.llm import quality as Q

from .conftest import prose


def lifted(x: np.ndarray) -> float:
    return Q._precision(np.cov(x.T, bias=True))[0]


def points(seed: int, n: int, odd: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = r.normal(0, [1.0, 1.5, 0.8, 0.4, 0.5], (n, 5))
    x[:odd] += [6, -5, 8, 2, 3]
    return x


def frame(spark, groups):
    rows = [(g, *map(float, p)) for g, x in groups.items() for p in x]
    return spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")


def test_least_determinant_by_brute_force(spark):
    """Every subset of h points of small groups; ties and shared bins may do a little better than any subset."""
    groups = {f"g{k}": points(k, 13, k % 4) for k in range(4)}
    groups["tied"] = np.repeat(points(9, 4, 1), [8, 2, 1, 1], axis=0)
    found = {r.grp: r for r in Q.estimate_groups(frame(spark, groups), 0.75).collect()}
    for g, x in groups.items():
        h = int(np.ceil(0.75 * len(x)))
        every = [lifted(x[list(c)]) for c in itertools.combinations(range(len(x)), h)]
        # concentration finds a local optimum: among the best hundredth of all subsets
        assert found[g].logdet <= np.quantile(every, 0.01) + 0.05, g
        assert found[g].n == len(x)


def test_outliers_do_not_move_the_estimate(spark):
    clean, odd = points(1, 400, 0), points(1, 400, 80)
    found = {r.grp: r for r in Q.estimate_groups(frame(spark, {"clean": clean, "odd": odd}), 0.75).collect()}
    for i in range(5):
        assert abs(found["clean"][f"m{i}"] - found["odd"][f"m{i}"]) < 0.35


def test_concentration_never_raises_the_determinant(spark):
    x = frame(spark, {"a": points(3, 300, 60), "b": points(4, 90, 20)})
    e = Q.store(Q._starts(x), "t")
    for _ in range(4):
        new = Q.store(Q._concentrate(x, e, 0.75), "t")
        both = new.join(e.select("grp", "start", F.col("logdet").alias("before")), ["grp", "start"]).collect()
        if _:
            assert len(both) == 8 and all(r.logdet <= r.before + 0.02 for r in both)
        e = new


def test_quantile():
    for beyond, x in ((0.5, 4.351), (0.05, 11.07), (0.001, 20.515)):
        assert abs(Q.chi2_quantile(beyond) - x) < 0.01


def test_each_dimension_can_reject():
    """But the last: the base rules end at three tenths of repeated words."""
    most = {2: np.log1p(100 * 6.0), 3: 1.0}
    for i, x in most.items():
        assert (x / Q.FLOORS[i]) ** 2 > Q.chi2_quantile(1e-8)


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(2)
    odd = lambda i: " ".join(f"#|##|##|#{i}{j}" for j in range(90))
    rows = [(i, prose(60 + i % 70, i), "en", "big") for i in range(120)] + [(1000, odd(0), "en", "big")]
    rows += [(2000 + i, prose(60 + i % 70, 500 + i), "de", f"small{i % 4}") for i in range(80)] + [(3000, odd(1), "de", "small1")]
    rows += [(4000 + i, prose(70, 900 + i), None, None) for i in range(5)] + [(5000, odd(2), None, None)]
    r.shuffle(rows)
    return {x.id: x for x in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


def test_verdicts_by_group(judged):
    """Own group, pool of a language, and a pool too small to reject."""
    assert not judged[1000].kept and not judged[3000].kept
    assert judged[5000].kept and judged[5000].distance is None
    assert sum(not x.kept for x in judged.values()) == 2
