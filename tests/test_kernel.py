"""The extraction kernel: our own cases for each construct and quirk."""

import random

import pytest

from webdistill.functions.text import collapse, head_units, pad_units, sound, trim, units
from webdistill.kernel import distill as K
from webdistill.kernel.dom import ELEMENT, node_rows, parse
from webdistill.kernel.entities import NAMES, decode, decode_at
from webdistill.kernel.render import MarkdownOptions, Renderer, Rule, escape_markdown
from webdistill.kernel.robots import group_for, is_allowed, parse_robots
from webdistill.kernel.scan import tokens
from webdistill.kernel.select import SelectorError, compile_selector, select_all, select_one
from webdistill.kernel.serialize import to_html


def conv(html, **style):
    return Renderer(MarkdownOptions.of(**style)).render(parse(html), 0)


def shape(html):
    """Tokens in short: tags with attributes, quoted text, comments."""
    out = []
    for t in tokens(html):
        if t.kind == "start":
            out.append("<" + " ".join([t.name, *(f"{k}={v}" for k, v in t.attributes)]) + ("/" if t.self_closing else "") + ">")
        elif t.kind == "end":
            out.append(f"</{t.name}>")
        else:
            out.append(f"{t.kind[0]}:{t.data or t.name}")
    return out


# ── text ──


def test_text_primitives():
    assert units("a😀b") == 4 and head_units("a😀b", 2) == "a�" and head_units("a😀b", 3) == "a😀"
    assert trim("﻿  x ") == "x" and trim("\x85x") == "\x85x"
    assert collapse("a　 \n\tb") == "a b" and pad_units("😀", 4) == "😀  "
    assert sound("😀 \ud800") == "😀 �"


# ── entities ──


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("&amp;lt;", "&lt;"), ("&copy 2", "© 2"), ("&copyright;", "&copyright;"), ("&ampx", "&ampx"), ("&#65;&#x42;&#X43", "ABC"), ("&#0;&#x110000;", "��"),
        ("&;&#;&#x;&", "&;&#;&#x;&"), ("&Prime;&prime;", "″′"), ("&AMP;", "&AMP;"), ("&#xD83D;&#xDE00;", "😀"), ("&#xD83D;x", "�x"), ("&constructor;", "&constructor;"),
        ("&#99999999999999999999;", "�"), ("&lang;&rang;", "⟨⟩"),
    ],
)
def test_decode(text, expected):
    assert decode(text) == expected


def test_decode_at():
    assert decode_at("x&amp;y", 2) == ("&", 4) and decode_at("&#x41 ", 1) == ("A", 4) and decode_at("&zz;", 1) == ("&", 0) and len(NAMES) == 59


# ── scanner ──


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("a <", ["t:a "]), ("a < b", ["t:a ", "t:< b"]), ("<<b>", ["t:<<b>"]), ("<div cla", []), ("<!>x>y", ["c:>x", "t:y"]), ("</>a</ x>", ["t:a", "c: x"]),
        ("<?x>", ["c:?x"]), ("<!doctype html>", ["d:html"]), ("<!DOCTYPE", []), ("<![CDATA[a&lt;]]>b", ["t:a<", "t:b"]), ("<![CDATA[a", ["t:a"]), ("<!-->a<!--->b<!---->", ["c:", "t:a", "c:", "t:b", "c:"]),
        ("<!--a--!>b-->", ["c:a--!>b"]), ("<!--a--->", ["c:a-"]), ("<!--a&amp;--", ["t:a&"]), ("<!--", []), ("<p a=1 b='2' C=\"3\" d e = f>", ["<p a=1 b=2 c=3 d= e=f>"]),
        ("<br class=a/>", ["<br class=a/>"]), ("<br/><br / x>", ["<br/>", "<br x=>"]), ("<a href='?a=1&copy=2'>", ["<a href=?a=1©=2>"]), ("<a<b>", ["<a<b>"]),
        ("<script>a<b&amp;</script >x", ["<script>", "t:a<b&amp;", "</script>", "t:x"]), ("<script>a</script x>", ["<script>", "t:a</script x>"]), ("<title>a&amp;</TITLE>", ["<title>", "t:a&", "</title>"]),
        ("<script/>a", ["<script/>", "t:a"]), ("<x =y>", ["<x =y=>"]), ("<x a'b=1>", ["<x a'b=1>"]), ("<x a=>", ["<x a=>"]), ("<x a='1'b=2>", ["<x a=1 b=2>"]), ("</p x=1>", ["</p>"]), ("<x a='", []),
    ],
)
def test_tokens(html, expected):
    assert shape(html) == expected


# ── tree ──


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"), ("<p><b>x<br><p>y", "<p><b>x<br><p>y</p></b></p>"), ("<ul><li>a<ul><li>b</ul>c", "<ul><li>a<ul></ul></li><li>b</li></ul>c"),
        ("<dl><dt>a<dd>b<dt>c", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
        ("<div/>x</br></q>", "<div></div>x"), ("<i><b>x</i>y", "<i><b>x</b></i>y"), ("<p a=1 b=2 a=3>", '<p a="3" b="2"></p>'), ("<table><li>a<table><li>b</table>", "<table><li>a<table><li>b</li></table></li></table>"),
    ],
)
def test_tree(html, expected):
    assert to_html(parse(html), 0) == expected


def test_intervals():
    rows = node_rows(parse("<a><b>x</b><c></c></a>y<!--z-->"))
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [
        (0, -1, 6, 0, 0, "document", None), (1, 0, 4, 1, 0, "element", "a"), (2, 1, 3, 2, 0, "element", "b"), (3, 2, 3, 3, 0, "text", None),
        (4, 1, 4, 2, 1, "element", "c"), (5, 0, 5, 1, 1, "text", None), (6, 0, 6, 1, 2, "comment", None),
    ]


# ── selectors ──


@pytest.mark.parametrize("text", ["", "  ", "a>b", "a + b", "a,b", "*", "a:hover", ".", "#", "[]", "a\tb", "[a='1' ]"])
def test_bad_selectors(text):
    with pytest.raises(SelectorError, match="Invalid selector"):
        compile_selector(text)


PAGE = "<div class='a  b' id=i data-x='1'><p class=a>1<span>s</span></p></div><p>2</p><a href>3</a>"


@pytest.mark.parametrize(
    ("text", "n"),
    [("p", 2), ("P", 2), (".a", 2), (".a.b", 1), ("div.a#i[data-x=1]", 1), ('[data-x="1"]', 1), ("[DATA-X]", 0), ("[href]", 1), ("[href=]", 1), ("[href=x]", 0), ("div p", 1),
     ("div span", 1), (".a .a span", 1), (".b .b", 0), ("[data-x^=1]", 0), (".A", 0), ("q", 0), ("div  p  span", 1)],
)
def test_select(text, n):
    tree = parse(PAGE)
    found = list(select_all(tree, 0, text))
    assert len(found) == n and select_one(tree, 0, text) == (found[0] if found else None)


def test_select_below_a_root():
    tree = parse("<div><p><b>x</b></p></div>")
    p = select_one(tree, 0, "p")
    assert [tree.tag[x] for x in select_all(tree, p, "div b")] == ["b"] and list(select_all(tree, p, "p")) == []


# ── rendering ──


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<ul>\n<li>a</li>\n<li>b</li>\n</ul>", "- a\n - b\n"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n- b\n"), ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> \n> \n> b\n"),
        ("<p>a<b> b </b>c</p>", "a**b**c\n"), ("<p><code>foo_bar</code></p>", "`foo\\_bar`\n"), ("<ol start=5><li>x</ol>", "1. x\n"), ("a < b", "a < b\n"), ("<p>x<b>y</b> - z</p>", "x**y** \\- z\n"),
        ("<p>&lt;b&gt; &copyright; &#0;</p>", "<b\\> &copyright; �\n"), ("<p>a</p>\n<p>b</p>", "a\n\n \n\nb\n"), ("<div>a</div><div>b</div>", "ab\n"),
        ('<pre><code class="language-js">a\n</code></pre>', "```js\na\n\n```\n"), ("<pre>*a*</pre>", "```\n*a*\n```\n"), ('<a href="u"></a>', "[](u)\n"), ("<a></a>", "\n"), ("<a>t</a>", "[t]()\n"), ("<p>1. x</p>", "\\1. x\n"),
        ("<script/>x<p>y</p></script>z", "x<p\\>y</p\\>z\n"), ("<a href=u title='t'>x</a>", '[x](u "t")\n'), ("<img src=s alt=a title=t>", '![a](s "t")\n'), ("<img data-src=d>", "![](d)\n"), ("<img src='' data-src=d>", "\n"),
        ("<code>a`b``</code>", "`` a\\`b\\`\\` ``\n"), ("<hr>", "---\n"), ("a<br>b", "a  \nb\n"), ("<b> </b><i></i>", "\n"), ("<figure>x<figcaption> c </figcaption></figure>", "x\n*c*\n"),
        ("<table></table>", "\n"), ("<table><caption>c</caption><tr></tr></table>", "\n"), ("<table><thead><tr><th>a<th>bb bb</thead><tr><td>1<p>2</table>", "| a    | bb bb |\n| ---- | ----- |\n| 1  2 |       |\n"),
        ("<ol><li>a</li><li>b<p>c</p></li></ol>", "1. a\n2. b\n   \n   c\n"), ("<li>x</li>", "- x\n"),
    ],
)
def test_render(html, expected):
    assert conv(html) == expected


def test_styles():
    assert conv("<h1>T</h1><h2>UV</h2><h3>W</h3>", heading_style="setext") == "T\n=\n\nUV\n--\n\n### W\n"
    assert conv("<h1>😀</h1>", heading_style="setext") == "😀\n==\n"
    assert conv("<ul><li>a</ul><em>b</em><b>c</b><hr><pre>d</pre>", bullet_list_marker="+", em_delimiter="_", strong_delimiter="__", hr="***", fence="~~~") == "+ a\n\n_b___c__\n\n***\n\n~~~\nd\n~~~\n"
    assert conv("<p>x</p>", code_block_style="indented", link_style="referenced") == "x\n"
    with pytest.raises(ValueError, match="no such option"):
        MarkdownOptions.of(fence="'''")


def test_own_rules_come_first():
    r = Renderer(rules=(Rule("p", lambda c, v, o: f"P({c})"),))
    r.add_rule(Rule(lambda v: v.attributes.get("class") == "x" and v.parent is None, lambda c, v, o: f"X[{v.tag}]"))
    r.add_rule(Rule(("i", "em"), lambda c, v, o: c.upper()))
    assert r.render(parse("<p>a<i>b</i></p><p class=x>c</p>"), 0) == "P(aB)X[p]\n"


def test_escape():
    assert escape_markdown("\\*_`[]#>~!|<&()") == "\\\\\\*\\_\\`\\[\\]\\#\\>\\~!|<&()"
    assert escape_markdown("- a\n + b\n12. c\n-d\n1) e") == "\\- a\n \\+ b\n\\12. c\n-d\n1) e"


# ── extraction ──

LONG = "This sentence is long enough to count as a paragraph, with commas, and more words than a title ever has. "


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        ("<title>A long title here - Site</title>", "A long title here"), ("<title>A - B | C</title>", "A - B"), ("<title> x </title>", "x"), ("<h1> H </h1>", "H"), ("", ""), ("<title></title><h1>H</h1>", "H"),
        ("<meta property='og:title' content=' O '><title>T</title>", "O"), ("<meta property='' name='og:title' content=O><title>T</title>", "T"), ("<meta name='twitter:title' content=W>", "W"),
        ("<meta property='og:title' content=''><title>T</title>", "T"), ("<title>Ab :: Cd</title>", "Ab :: Cd" if 2 <= 8 * 0.3 else "Ab"),
    ],
)
def test_title(head, expected):
    assert K.title(parse(head)) == expected


def test_byline_and_site():
    assert K.byline(parse("<nav class=author> </nav><p id=Byline>By <b>me</b></p>")) == "By me"
    assert K.byline(parse("<meta name=author content=' A '><p class=author>B</p>")) == "A"
    assert K.byline(parse(f"<p class=author>{'x' * 200}</p><a rel=author>L</a>")) == "L"
    assert K.byline(parse("<p>x")) is None and K.site_name(parse("<meta name='og:site_name' content=S>")) == "S"


def test_scores():
    assert K.class_weight("brand ") == 0 and K.class_weight("article sidebar") == 0 and K.class_weight("MAIN ") == 25 and K.class_weight("hid ") == -25 and K.class_weight(" hid x") == -25
    assert K.paragraph_score("a,b、c" + "x" * 400) == 6 and K.paragraph_score("") == 1
    tree = parse(f"<html><body><div><section><p>{LONG}</p><td>short</td></section></div></body></html>")
    found = {tree.tag[x]: s for x, s in K.scores(tree, tree.first(0, "body")).items()}
    own = K.paragraph_score(LONG)
    assert found == {"section": 5 + own, "div": 5 + own / 2, "body": own / 6, "html": own / 9}


def test_density():
    m = parse("<div>ab<a>cd<a>e</a></a><p><a>f</a></p></div>")
    d = m.measure(0)
    assert d.length[1] == 6 and d.linked[1] == 4 and d.density(next(m.by_tag(0, "a"))) == pytest.approx(1 / 3)


def full(html, **o):
    return K.distill(html, K.ExtractOptions(**o))


def test_whole_pages():
    assert full("plain text").markdown == "\n"
    page = f"<html><head><title>T</title></head><body><nav>menu</nav><div class='sidebar'>side</div><article><h1>H</h1><p>{LONG * 6}</p><h2><a href='#t'>Gone</a></h2><p class=comment>short</p><img data-src=i.png></article><footer>f</footer></body></html>"
    got = full(page).markdown
    assert got.startswith("# H\n\nThis sentence") and "menu" not in got and "side" not in got and "Gone" not in got and "short" not in got and "![](i.png)" in got
    assert "side" in full(page, include=(".sidebar",), char_threshold=10**6).markdown
    assert "This" not in full(page, remove=("article p",)).markdown
    assert full(page, select="h1").markdown == "# H\n" and full(page, select="nav").markdown == got and full(page, select="").markdown == got
    assert full(page, top_candidates=0, char_threshold=0).excerpt.startswith("HThis sentence")


def test_div_becomes_paragraph():
    assert full("<body><div class=x>a</div><div><ul><li>b</ul></div>", select=".x").markdown == "a\n"
    assert full("<body><div class=x>a</div>", select="div.x").markdown == "a\n"


def test_siblings_are_merged():
    p = f"<p>{LONG}</p>"
    got = full(f"<body><div id=o><div class='article'>{p * 8}<ul></ul></div>{p}<p>x</p></div></body>", char_threshold=10).markdown
    assert got.count("This sentence") == 9 and "x\n" not in got.replace("words than a title ever has. \n", "")


def test_threshold_falls_back_to_the_body():
    got = full(f"<body><h2>Kept by the fallback</h2><section class=article><p>{LONG}</p></section></body>").markdown
    assert "Kept by the fallback" in got and "Kept" not in full(f"<body><h2>Kept</h2><section class=article><p>{LONG}</p></section></body>", char_threshold=5).markdown


def test_empty_elements_and_images():
    page = "<body><div class=x><p><img src=a></p><p> </p><table><tr><td></td><td>c</td></tr></table></div></body>"
    assert full(page, select=".x").markdown == "![](a)\n\n| c   |\n| --- |\n"
    assert full(page, select=".x", keep_images=False).markdown == "| c   |\n| --- |\n"
    assert "![](s)" in full("<body><p class=x>t<img src='' data-srcset=s></p>", select=".x").markdown


def test_golden_page(spark, sf):
    html = spark.read.parquet(f"{sf}/pages.parquet").filter("page_id = 2").first().html
    page = K.distill(html)
    assert page == K.Page("Reorea. Nd.", "Ascirr para osóciónta cióngañ no.\n\n# Reorea. Nd.\n\n**Reorea. Nd.**\n", "Ascirr para osóciónta cióngañ no.Reorea. Nd.Reorea. Nd.", None, None)


def test_never_raises():
    r = random.Random(5)
    parts = [*"<>/!-?=\"'& abp;#x", "<p>", "<div>", "</div>", "<td>", "<table>", "<script>", "]]>", "<![CDATA[", "<!--", "-->", "&amp", "<title>", "<tr>", "<li>", "<a href=x>", "<pre>", "<code>", "</a>"]
    for _ in range(1500):
        page = K.distill("".join(r.choice(parts) for _ in range(r.randint(0, 60))))
        assert page.markdown.endswith("\n") and "\n\n\n" not in page.markdown
    deep = K.distill("<div>" * 20000 + LONG)
    assert "This sentence" in deep.markdown and all(k in (0, ELEMENT, 3, 8) for k in parse("<b>x").kind)


# ── robots ──


@pytest.mark.parametrize(
    ("body", "agent", "path", "allowed"),
    [
        ("", "a", "/", True), ("User-agent: *\nDisallow: /x", "a", "/xy", False), ("User-agent: *\nDisallow: /x$", "a", "/xy", True), ("User-agent: *\nDisallow: /*.gif$", "a", "/d/e.gif", False),
        ("User-agent: a\nDisallow:\nUser-agent: b\nDisallow: /x", "a", "/x", False), ("User-agent: *\nDisallow: /\nAllow: /a", "z", "/ab", True), ("User-agent: *\nDisallow: /a\nAllow: /a", "z", "/a", True),
        ("User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b", "z", "/a", True), ("Disallow: /q", "z", "/q", False), ("User-agent:\nDisallow: /", "z", "/", False), ("User-agent: Web\nDisallow: /", "webdistill/0.1", "/", False),
        ("user-agent: webdistill/0.1-beta\nDISALLOW: /", "webdistill/0.1", "/", False), ("User-agent: *\nDisallow: /x # c", "z", "/x", False), ("User-agent: *\nDisallow: /x # c\r\n", "z", "/x", True), ("User-agent: *\nDisallow: /a.b", "z", "/aXb", True),
        ("User-agent: *\nDisallow: /a?b", "z", "/a?b=1", False), ("User-agent: *\nDisallow: /" + "*a" * 30 + "$", "z", "/" + "a" * 40 + "b", True),
    ],
)
def test_robots(body, agent, path, allowed):
    assert is_allowed(parse_robots(body), agent, path) is allowed


def test_robots_groups():
    groups = parse_robots("User-agent: A\nUser-agent: b\nAllow: /1\n\nnonsense\nUser-agent: *\nDisallow: /2\n")
    assert [(g.agents, g.rules) for g in groups] == [(["a", "b"], [("allow", "/1")]), (["*"], [("disallow", "/2")])]
    assert group_for(groups, "Bot") is not None and group_for(groups[:1], "zzz") is None


@pytest.mark.parametrize("html", ["<ol>" + "<li>a" * 8_000 + "</ol>", "<div><p>a b c d e f g h i j k l m n o p q r s t u v w x y z, and on</p>" * 1_500, "<span>" * 8_000 + "</x>" * 8_000, "<i>" * 8_000 + "<li>a" * 8_000])
def test_time_grows_with_the_page(html):
    import time

    began = time.perf_counter()
    K.distill(html)
    assert time.perf_counter() - began < 10
