import random

import pytest

WORDS = "the of and to in is that for with on as by was it be this are from or an at not have which but all can one we you they more".split()


def prose(n: int, seed: int, lines: int = 0) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(["", "", "er", "é", "ñing", "ö", "ß"]) + str(r.randint(0, 99)) * (r.random() < 0.2) for _ in range(n)]
    for i in range(12, len(words), 23 if lines else 10**9):
        words[i] += ".\n"
    return " ".join(words)


def hazards() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and odd texts, repeated rows, ties, copies, shared passages and lines, one very long text."""
    base = prose(300, 1, 1)
    passage = prose(70, 2)
    line = "A common line that is certainly longer than forty characters, ÄÖ"
    near = base.split(" ")
    near[150] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "\n\n"), (7, base), (8, base), (9, base.upper()), (10, " ".join(near)),
        (11, prose(100, 3) + " " + passage + " " + prose(80, 4)), (12, prose(90, 5) + " " + passage), (13, passage), (14, "ab " * 400), (15, "a" * 5000),
        (16, "日本語の文章。" * 80), (17, prose(30000, 6, 1)), (18, "x\x00y \x7f <b>& | $ % # * >"), (19, "😀 " * 60),
    ]
    rows += [(20 + i, f"{prose(40, 10 + i)}\n  {line if i % 2 else line.upper()} \t\n{prose(30, 40 + i)}") for i in range(6)]
    rows += [(7, base), (7, base), (1, None), (30, prose(50, 77)), (30, prose(50, 77))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return hazards()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns carry names that operators use inside."""
    r = random.Random(9)
    full = [(d, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t) if t is not None else None, 1, "x", 2, 3.0, "y") for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, th string, fp long, n double, rows string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def same(found, expected):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    found, expected = sorted(map(tuple, found), key=key), sorted(map(tuple, expected), key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == b
