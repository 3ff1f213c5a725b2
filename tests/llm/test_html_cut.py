"""Operator 10: the cut decides where names and text disagree, and no page takes long."""

import itertools
import random
import time

import pytest

from webdistill.llm import htmlmain as H

PROSE = [
    "The committee met on Tuesday, and after a long debate, it agreed to publish the full report in the spring of next year.",
    "Nobody had expected the second vote, which came late in the evening, to change the outcome of the first one so clearly.",
    "By the end of the week, most of the delegates had left the town, and the streets were as quiet as they had been before.",
]
MENU = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "Sports", "Weather", "About")) + "</ul>"
TEXT = "\n".join(PROSE)
P = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.fixture
def flows(monkeypatch):
    count = [0]
    plain = H.FlowNetwork.source_side

    def counted(self):
        count[0] += 1
        return plain(self)

    monkeypatch.setattr(H.FlowNetwork, "source_side", counted)
    return count


@pytest.mark.parametrize("page", [
    f"<body><form method=post>{MENU}<div>{P}</div><nav>{MENU}</nav></form></body>",  # a page that is one form
    f"<body><nav>{MENU}</nav><div class=widget>{P}</div><footer>&copy; us</footer></body>",  # a layout's name round the text
    f"<body><div class=header-overlay><div>{MENU}</div><div>{P}</div></div></body>",
    f"<body><div>{MENU}</div><div>{P}</div><div>{MENU}</div></body>",  # no names at all
    f"<body><div class=content>{MENU}{P}{MENU}</div></body>",  # menus in a main column
])
def test_text_outvotes_names(page):
    names = "\n".join(b.text for b in H.parse(page) if b.place > 0)
    assert H.extract(page) == TEXT and names != TEXT


def test_neighbours_decide(flows):
    """A short odd block stays within the text that surrounds it, and alone goes."""
    odd = "<p>Weather data</p>"
    blocks = H.parse(odd)
    H.describe(blocks)
    assert sum(w * x for w, x in zip(H.DEFAULT_WEIGHTS, blocks[0].features, strict=True)) < 0
    assert H.extract(f"<div><p>{PROSE[0]}</p>{odd}<p>{PROSE[1]}</p></div>") == f"{PROSE[0]}\nWeather data\n{PROSE[1]}"
    assert H.extract(f"<div>{odd}</div>") == ""
    assert flows[0] > 0


def test_adverts_inside_an_article_go():
    for advert in ("<div class=ad><p>Buy this now, it is cheap.</p></div>", "<aside><p>Read more of this, as all others do.</p></aside>", f"<form><p>{PROSE[2]}</p></form>"):
        assert H.extract(f"<article><p>{PROSE[0]}</p>{advert}<p>{PROSE[1]}</p></article>") == f"{PROSE[0]}\n{PROSE[1]}"


def test_flow_runs_on_pages(spark, flows):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        H.extract(r.html)
    assert flows[0] > 0


def test_labels_of_whole_pages_are_a_least_cut(monkeypatch):
    """Against every labelling of random small pages."""
    r = random.Random(3)
    seen = []
    plain = H.min_cut
    monkeypatch.setattr(H, "min_cut", lambda score, edges: seen.append((score, edges, plain(score, edges))) or seen[-1][2])
    for _ in range(120):
        page = "".join(
            f"<{t}{r.choice(['', ' class=widget', ' class=content', ' class=ad'])}><p>{' '.join(r.choice(PROSE).split()[: r.randint(1, 20)])}</p>{r.choice(['', MENU[:60] + '</li></ul>'])}</{t}>"
            for t in (r.choice(["div", "section", "form", "td"]) for _ in range(r.randint(1, 4)))
        )
        H.extract(page)
    assert any(len(s) > 4 for s, _, _ in seen)
    for score, edges, found in seen:
        cost = lambda x: sum(max(s, 0) if not v else max(-s, 0) for s, v in zip(score, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B023
        assert cost(found) <= min(map(cost, itertools.product([False, True], repeat=len(score)))) + 0.02


HOSTILE = {
    "tags without end": "<script " * 60_000, "quotes": "<a \"'x " * 70_000, "open value": '<a x="' * 90_000, "both quotes": "<a x='>\"y=\"" * 50_000 + ">", "video": "<video>" * 70_000 + "</video>",
    "nested": "<div>" * 100_000 + "x", "end tags": "<div>" * 50_000 + "</x>" * 50_000, "inline end tags": "<b><p>" + "<i>" * 50_000 + "</b>" * 50_000, "references": "&#" + "1" * 400_000 + ";" + "&" * 300_000,
    "attribute": "<p " + "a" * 500_000 + ">x", "class": "<p class='" + "A" * 500_000 + "'>x", "cdata": "<![CDATA[" * 60_000, "comments": "<!--" * 200_000, "signs": "<" * 500_000,
    "widgets": f"<div class=widget><p>{PROSE[0]}</p>{MENU}</div>" * 2_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_long_hostile_pages(name):
    began = time.perf_counter()
    H.extract(HOSTILE[name])
    assert time.perf_counter() - began < 10
