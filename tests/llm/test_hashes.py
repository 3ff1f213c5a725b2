"""Texts that polynomial hashes modulo a power of two can't tell apart, long texts in parts, and common prefixes."""

import random

import numpy as np
import pytest

from webdistill.llm import jaccard, passages, quality, substrings
from webdistill.llm.repeats import Windows, byte_units, text_blocks, word_spans, word_units
from webdistill.llm.suffixes import shares_prefix, sort_suffixes

from . import brute
from .conftest import prose, same
from .test_dedup import digest2, digest6


def thue_morse(n: int) -> tuple[str, str]:
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


X, Y = thue_morse(4096)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize("join", ["", " "])
def test_jaccard_on_thue_morse(spark, join):
    texts = [f"one {join.join(X)} two", f"one {join.join(Y)} two", join.join(X), join.join(X)]
    found = jaccard.jaccard_components(frame(spark, texts)).select("id", "n_shingles", "component_id").collect()
    same(found, brute.op3(list(enumerate(texts, 1))))


def test_passages_on_thue_morse(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [f"{X} {rest}", f"{Y} {rest}", " ".join(X[:1024]), " ".join(Y[:1024])]
    same(digest6(passages.dedup_passages(frame(spark, texts))), brute.op6(list(enumerate(texts, 1))))
    same(digest6(passages.dedup_passages(frame(spark, texts), window=1024)), brute.op6(list(enumerate(texts, 1)), 1024))


def test_substrings_on_thue_morse(spark):
    texts = [X, Y + "c", prose(40, 1) + X[:2048], Y[:2048] + prose(40, 1)]
    for length, gram in ((200, 40), (2048, 1024)):
        same(digest2(substrings.dedup_substrings(frame(spark, texts), length=length, gram=gram)), brute.op2(list(enumerate(texts, 1)), length))


def test_quality_on_thue_morse(spark):
    texts = [" ".join([X, *"abcdefg", Y, *"abcdefg", *(f"w{i}" for i in range(30))])]
    found = quality.quality_rules(frame(spark, texts).selectExpr("doc_id", "text", "'en' lang", "'s' source")).collect()
    assert found[0].n_repeat_words == brute.op9_base(texts[0])[4]


def test_word_units_tell_words_apart():
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab\x01é") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300, 900]))) for _ in range(3000)} | {X, Y, "a" * 8, "a" * 9, "\x00", "\x00\x00"})
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    for which in (0, 1):
        assert len(np.unique(word_units(raw, start, end, which))) == len(words)
    twice = np.frombuffer((" ".join(words) + "  " + " ".join(words)).encode(), dtype=np.uint8)
    start, end, _ = word_spans(twice, np.array([0, len(twice)]))
    h = word_units(twice, start, end)
    assert (h[: len(words)] == h[len(words) :]).all()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 13, 35, 200])
def test_windows_by_place_and_all(size):
    units = byte_units(np.frombuffer((prose(90, 2) * 3).encode(), dtype=np.uint8))
    raw = (prose(90, 2) * 3).encode()
    for least in {size, (size + 1) // 2, 1}:
        h = Windows(units, least).of(np.arange(len(raw) - size + 1), size)
        names = {}
        for i, x in enumerate(h.tolist()):
            assert names.setdefault(raw[i : i + size], x) == x
        assert len(set(names.values())) == len(names)
    assert (Windows(units, size).all(size) == Windows(units, size).of(np.arange(len(raw) - size + 1), size)).all()


def test_long_texts_in_parts():
    """Reading a text in parts leaves every window in exactly one block, and equal windows meet by their anchors."""
    raw = np.frombuffer((prose(900, 3) + prose(200, 4) + prose(200, 4)).encode(), dtype=np.uint8)
    bounds = np.array([0, 700, len(raw)])
    for unit, length, k in (("byte", 60, 12), ("word", 9, 3)):
        whole = [np.concatenate(x) for x in zip(*text_blocks(raw, bounds, unit, length, k), strict=True)]
        parts = [np.concatenate(x) for x in zip(*text_blocks(raw, bounds, unit, length, k, most=100), strict=True)]
        spread = lambda b: {(t, i): a for a, t, first, last in zip(*(b[j].tolist() for j in (0, 2, 3, 4)), strict=True) for i in range(first, last + 1)}
        assert spread(whole) == spread(parts) and len(parts[0]) > len(whole[0])
        assert sum((parts[4] - parts[3] + 1).tolist()) == len(spread(parts))


@pytest.mark.parametrize("width", [1, 10**9])
def test_shares_prefix(width):
    r = random.Random(7)
    strings = [np.array([r.randint(1, r.choice([1, 2, 3])) for _ in range(r.randint(0, 60))] * r.randint(1, 3) + [0]) for _ in range(60)]
    text, sa, order = sort_suffixes(strings, width)
    lengths = np.array([len(strings[i]) for i in order])
    owner = np.repeat(np.arange(len(order)), lengths)
    end = np.cumsum(lengths)
    for length in (1, 2, 5, 11):
        expected = [i > 0 and owner[sa[i]] == owner[sa[i - 1]] and max(sa[i], sa[i - 1]) + length <= end[owner[sa[i]]]
                    and (text[sa[i] : sa[i] + length] == text[sa[i - 1] : sa[i - 1] + length]).all() for i in range(len(sa))]
        assert shares_prefix(text, sa, lengths, length).tolist() == [bool(x) for x in expected]
