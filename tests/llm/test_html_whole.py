"""Operator 10 on opaque elements without an end tag and on math, xmp and object."""

import pytest

from webdistill.llm import htmlmain

FIRST, LAST = "The first paragraph of the text has ten words or so.", "The last paragraph of the text, with a stop, ends it."


@pytest.mark.parametrize("tag", ["video", "audio", "svg", "canvas", "object", "math", "noscript", "template", "select"])
def test_unclosed_elements_cut_nothing(tag):
    both = f"{FIRST}\n{LAST}"
    assert htmlmain.extract(f"<body><article><p>{FIRST}</p><{tag} a=b><p>{LAST}</p></article>") == both
    assert htmlmain.extract(f"<body><{tag}><article><p>{FIRST}</p><p>{LAST}</p></article>") == both
    assert htmlmain.extract(f"<article><div><p>{FIRST}</p><{tag}></div>{LAST}</article>") == both


def test_another_ones_end_tag():
    assert htmlmain.extract(f"<article><video><p>{FIRST}</p><video>old</video><p>{LAST}</p></article>") == f"{FIRST}\n{LAST}"


def test_math_xmp_and_fallback_are_text():
    page = f"<article><p>{FIRST} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><xmp><b>a</b></xmp><object data=x><p>{LAST}</p></object></article>"
    assert htmlmain.extract(page) == f"{FIRST} x=1\n<b>a</b>\n{LAST}"
