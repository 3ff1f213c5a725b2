"""Operators, configuration, tools, streaming and the queries against their SQL."""

import json
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from webdistill import config as C
from webdistill import tools
from webdistill.cli import main
from webdistill.functions import native as N
from webdistill.functions.sql import register
from webdistill.kernel import distill as K
from webdistill.kernel.dom import parse
from webdistill.kernel.render import escape_markdown
from webdistill.kernel.robots import is_allowed, parse_robots
from webdistill.kernel.select import select_all
from webdistill.operators import domrel, pages as P, robots as R, site_rules as S
from webdistill.plans import queries as Q
from webdistill.sources import pages as src
from webdistill.streaming import pages as stream


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_agrees_with_sql(spark, sf, con, name):
    found, expected = Q.QUERIES[name](spark, sf).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist())
    assert rows(found) == rows(expected) and len(found)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() == 50 and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "<p>a<b>c</b>"), (4, "&#xD800;<p class='x y' id=z>t</p>"), (5, "<div><div class=article><p>" + "word, " * 60 + "<a href=u>l</a></p></div><a>x<a>y</a></a></div>")]
    return spark.createDataFrame(rows, "page_id long, html string")


def test_odd_pages(spark, odd):
    found = {r.page_id: r for r in P.html_to_markdown(odd).collect()}
    assert found[1].markdown == found[2].markdown == "\n" and found[1].error is None and found[3].markdown == "a**c**\n"
    assert P.html_to_markdown(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="Invalid selector"):
        P.html_to_markdown(odd, C.Options(remove=("a>b",)))


def test_relational_and_kernel_selection_agree(odd):
    nodes = P.html_nodes(odd).cache()
    for text in ("p", "div p", "div div.article p a", ".x.y#z", "[href]", "a a", "[href=u]", "q"):
        found = {(r.page_id, r.node_id) for r in domrel.select(nodes, text).collect()}
        expected = {(r.page_id, x) for r in odd.collect() for x in select_all(parse(r.html or ""), 0, text)}
        assert found == expected, text
    nodes.unpersist()


def test_relational_and_kernel_scores_agree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(12).cache()
    nodes = P.html_nodes(pages).cache()
    dense = {(r.page_id, r.node_id): (r.text_length, r.link_length) for r in domrel.link_density(domrel.elements(nodes), nodes).collect()}
    scored = {(r.page_id, r.node_id): r.content_score for r in domrel.candidates(nodes).collect()}
    for r in pages.collect():
        tree = parse(r.html)
        m = tree.measure(0)
        for x in tree.elements(0):
            assert dense[r.page_id, x] == (m.length[x], m.linked[x])
        for x, s in K.scores(tree, tree.first(0, "body")).items():
            assert scored[r.page_id, x] == pytest.approx(s)
        texts = {t.node_id: t.text for t in domrel.text_content(domrel.by_tag(nodes, "p", "footer").filter(F.col("page_id") == r.page_id), nodes).collect()} if r.page_id < 2 else {}
        assert all(tree.text(x) == t for x, t in texts.items())
    nodes.unpersist()


def test_relational_pruning(odd):
    nodes = P.html_nodes(odd)
    assert domrel.without(nodes, domrel.by_tag(nodes, "div")).filter("page_id = 5").count() == 1
    assert {r.node_id for r in domrel.protected(nodes, ["p a"]).filter("page_id = 5").collect()} == {1, 2, 3, 5}
    assert {r.tag for r in domrel.siblings(domrel.select(nodes, ".article"), nodes).collect()} == {"a"}
    assert domrel.drop_unlikely(nodes).count() == nodes.count()


def test_native_text_agrees_with_python(spark):
    texts = ["", " - a", " x - y ", "1. z\r2. w", "a😀b" * 80, "*_~`[]#>\\", "x,、" * 40, "\u0085 \u001c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", N.md_escape("t").alias("e"), N.js_trim("t").alias("s"), N.u16_length("t").alias("n"), N.paragraph_score("t").alias("p"), N.collapse_ws("t").alias("c"), N.finish_markdown("t").alias("f")).collect()
    from webdistill.functions.text import collapse, trim, units
    from webdistill.kernel.render import finish

    for r in rows:
        t = texts[r.i]
        assert (r.e, r.s, r.n, r.p, r.c, r.f) == (escape_markdown(t), trim(t), units(t), K.paragraph_score(t), collapse(t), finish(t)), repr(t)


BODIES = {
    "http://a": "User-agent: *\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: webdistill\nuser-agent: b\nDisallow: /*/p\nAllow: /q/p?z", "http://b": "Disallow: /\nAllow: /a.b+c(\n",
    "http://c": "User-agent: q\nDisallow:\nUser-agent: *\nDisallow: /k # no\r\nDisallow: /m#n", "http://d": "", "http://e": "User-agent: *\nDisallow: /1\nUser-agent: *\nDisallow: /2",
}


def test_robots_tables_agree_with_the_kernel(spark):
    paths = ["/", "/x", "/x/y", "/x/yz", "/q/p?z", "/q/p", "/a.b+c(1", "/aXb+c(", "/k", "/m", "/1", "/2"]  # a URL's path has no fragment
    urls = [(i, o + p) for i, (o, p) in enumerate((o, p) for o in [*BODIES, "http://none"] for p in paths)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    bodies = spark.createDataFrame(list(BODIES.items()), "origin string, body string")
    for agent in (R.AGENT, "zed", "q"):
        for r in R.decide(pages, bodies, agent=agent).collect():
            origin = re.match("http://[a-z]+", r.url)[0]
            assert r.allowed is is_allowed(parse_robots(BODIES.get(origin, "")), agent, r.url[len(origin) :]), (agent, r.url)
    assert R.gate(pages, bodies).count() == R.decide(pages, bodies).filter("allowed").count()
    assert R.gate(pages, bodies, force=True).count() == pages.count()


def test_site_rules(spark):
    rules = (C.SiteRule("a.com", ("x",)), C.SiteRule(re.compile(r"/\d+$"), include=("y",), select="s"), C.SiteRule("a", ("z",), select="t"))
    pages = spark.createDataFrame([(1, "http://a.com/12"), (2, "http://b/x"), (3, None), (4, "http://c/a")], "page_id long, url string")
    found = {r.page_id: (r.remove, r.include, r.select) for r in S.resolve(pages, S.rules_table(spark, rules)).collect()}
    assert found == {1: (["x", "z"], ["y"], "s"), 2: ([], [], None), 3: ([], [], None), 4: (["z"], [], "t")}
    for i, url in pages.collect():
        o = C.resolve_for(url, C.Options(site_rules=rules))
        assert (list(o.remove), list(o.include), o.select) == found[i]


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert C.read_config() is None
    for text, message in (("{", "Invalid JSON"), ("[]", "must contain a JSON object")):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(C.ConfigError, match=message):
            C.read_config("c.json")
    with pytest.raises(C.ConfigError, match="Failed to read"):
        C.read_config("missing.json")
    assert C.write_config("c.json", {"remove": ["a"], "charThreshold": 7, "select": None, "converter": {"headingStyle": "setext"}})["charThreshold"] == 7
    C.write_config("c.json", {"siteRules": [{"url": "u", "include": ["i"]}]})
    assert (tmp_path / "c.json").read_text().endswith("}\n") and json.loads((tmp_path / "c.json").read_text())["remove"] == ["a"]
    low = C.options_of(C.read_config("c.json"))
    high = C.Options(remove=("b",), markdown={"fence": "~~~"}, char_threshold=None, keep_images=False)
    o = C.merge(low, high)
    assert (o.remove, o.char_threshold, o.keep_images, o.markdown) == (("b", "a"), 7, False, {"heading_style": "setext", "fence": "~~~"})
    assert o.site_rules[0].include == ("i",) and o.extract().char_threshold == 7 and C.options_of(None) == C.Options()


SITE = {"http://s/p?q": "<title>T</title><body><p>hello<a href=x>y</a></body>", "http://s/robots.txt": "User-agent: *\nDisallow: /p?"}


def fetch(url, headers):
    assert headers["User-Agent"].startswith("webdistill/")
    return (200, SITE[url]) if url in SITE else (404, "")


def test_tools(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert tools.convert("http://s/p?q", fetch=fetch) == "# T\n\n---\n\nhello[y](x)\n"
    assert tools.select("http://s/p?q", "a", fetch=fetch) == 'Found 1 element(s) matching "a":\n\n[1] <a href="x">y</a>'
    assert tools.select_markdown("http://s/p?q", "p", fetch=fetch) == 'Found 1 element(s) matching "p":\n\n[1]\nhello[y](x)\n'
    assert tools.select("http://s/p?q", "q", fetch=fetch) == "No elements matched selector: q"
    with pytest.raises(tools.Blocked, match="Blocked by robots.txt"):
        tools.to_markdown("http://s/p?q", C.Options(respect_robots=True), fetch=fetch)
    assert tools.to_markdown("http://s/p?q", C.Options(respect_robots=True, force=True), fetch=fetch)[1] is True
    with pytest.raises(src.FetchError, match="Failed to fetch http://s/none: 404"):
        tools.convert("http://s/none", fetch=fetch)
    assert json.loads(tools.configure(tmp_path / "w.json", {"select": "p"})) == {"select": "p"} and tools.configure(tmp_path / "none.json") if (tmp_path / "none.json").exists() else True


def test_cli(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "p.html").write_text("<body><h1>A</h1><p class=x>b</p></body>", encoding="utf-8")
    assert main(["p.html", "--heading-style", "setext", "--bullet-marker", "?"]) == 0 and capsys.readouterr().out == "A\n=\n\nb\n"
    assert main(["p.html", "-o", "o.md", "--remove", ".x"]) == 0 and (tmp_path / "o.md").read_text() == "# A\n"
    assert main(["p.html", "--select", "h1", "--include", "p"]) == 0 and capsys.readouterr().out == "# A\n"
    assert main([]) == 1 and main(["none.html"]) == 1 and "webdistill:" in capsys.readouterr().err
    assert main(["http://s/p?q", "--respect-robots-txt"], fetch=fetch) == 1
    assert main(["http://s/p?q", "--respect-robots-txt", "-f"], fetch=fetch) == 0 and "proceeding" in capsys.readouterr().err


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    assert src.read_html_files(spark, str(tmp_path)).first().html == "<p>\nx</p>"
    urls = spark.createDataFrame([("http://s/p?q",), ("http://s/none",)], "url string")
    site = dict(SITE)
    found = {r.url: r for r in src.fetch_pages(urls, lambda u, h: (200, site[u]) if u in site else (404, "")).collect()}
    assert found["http://s/p?q"].html == SITE["http://s/p?q"] and "404" in found["http://s/none"].error
    assert src.fetch_robots("http://none/", fetch) == "" and src.fetch_robots("http://s/", fetch).startswith("User-agent")
    src.write_markdown(P.html_to_markdown(src.from_strings(spark, ["<p>a", "<p>b"])), str(tmp_path / "out"))
    assert {r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a\n", "b\n"}


def test_streaming(spark, sf, tmp_path):
    arriving = tmp_path / "in"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(3).write.parquet(str(arriving))
    made = stream.distill_stream(stream.read_stream(spark, str(arriving), 1), fields=("title", "markdown"))
    q = stream.write_stream(made, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    rows = lambda d: sorted((r.page_id, r.markdown) for r in d.select("page_id", "markdown").collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(P.html_to_markdown(pages))


def test_sql_functions(spark, sf):
    register(spark)
    spark.read.parquet(f"{sf}/pages.parquet").limit(3).createOrReplaceTempView("p3")
    r = spark.sql("select html_title(html) t, html_to_markdown(html).title u, md_escape('*') e, decode_entities('&lt;') d, class_weight('main ') c, robots_allowed('User-agent: *\nDisallow: /', 'x', '/') a from p3").first()
    assert r.t == r.u and (r.e, r.d, r.c, r.a) == ("\\*", "<", 25, False)
    assert spark.sql("select * from p3, lateral html_nodes(html) where tag = 'h1'").count() == 3
    assert spark.sql("select * from p3, lateral html_tokens(html) where kind = 'eof'").count() == 3
    assert {x.html[:2] for x in spark.sql("select s.html from p3, lateral select_html(p3.html, 'nav a') s").collect()} == {"<a"}
    assert all(x.markdown.startswith("# ") for x in spark.sql("select markdown from p3, lateral select_markdown(html, 'h1')").collect())


def test_pushdown(spark, sf):
    """A filter on the id reaches the scan below the kernel, and only two columns are read."""
    plan = P.html_to_markdown(spark.read.parquet(f"{sf}/pages.parquet").filter("page_id < 10"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(page_id), LessThan(page_id,10)]" in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan and plan.count("MapInArrow") >= 1


def test_dealt_nodes_are_parsed_once_and_not_moved_again(spark, sf):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    nodes = domrel.dealt(P.html_nodes(spark.read.parquet(f"{sf}/pages.parquet")))
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    plan = domrel.by_tag(nodes, "p").groupBy("page_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" not in plan
    top = domrel.top_candidates(domrel.strip(nodes))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in top


@pytest.mark.parametrize("name", ["nesting", "div_to_paragraph"])
def test_nodes_are_not_broadcast(spark, sf, name):
    """All nodes at the driver break it at size, however small Spark takes them for."""
    found = Q.QUERIES[name](spark, sf)
    assert found.count() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_failing_page_is_a_row():
    def fails(html):
        if html == "bad":
            raise ValueError("no")
        return [(1, html)]

    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("html", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["a", "bad", None])], names=["page_id", "html"])
    out = [tuple(r.values()) for b in P._expand(fails, schema, lambda e: (0, e))([batch]) for r in b.to_pylist()]
    assert out == [(1, 1, "a"), (2, 0, "ValueError: no"), (None, 1, "")]
