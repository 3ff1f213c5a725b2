"""The engine's own operators as queries over the driver's tables, with the SQL each must agree with.

Where a table has no HTML of the wanted shape, the HTML is written from relational rows with SQL
functions and then parsed, so that parser, renderer and oracle share nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options, SiteRule
from ..functions import native as N
from ..kernel import distill as K
from ..kernel.render import MarkdownOptions
from ..operators import domrel, pages as P, robots as R, site_rules as S

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


# ── SQL building blocks: what the corpus' pages look like to regular expressions ──

_WS = r"[\t\n\x0B\f\r\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _collapse(c: str) -> str:
    return f"regexp_replace({c}, '{_WS}+', ' ', 'g')"


def _decode(c: str) -> str:
    """The references that the corpus uses; ampersands last.  '&am' and the like are no references."""
    out = c
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace(regexp_replace({out}, '&amp;', '&', 'g'), '&amp($|[^A-Za-z0-9])', '&\\1', 'g')"


def _escape(c: str) -> str:
    special = f"regexp_replace({c}, '([\\\\*_`\\[\\]#>~])', '\\\\\\1', 'g')"
    return f"regexp_replace({special}, '^({_WS}*)([-+]|[0-9]+\\.) ', '\\1\\\\\\2 ')"


_TITLE_RAW = r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_H1_RAW = r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


def _cut_title(c: str) -> str:
    cases = " ".join(
        f"WHEN strpos({c}, '{s}') > 1 AND length({c}) - strpos(reverse({c}), '{s[::-1]}') - {len(s)} + 1 > length({c}) * 0.3 "
        f"THEN {_trim(f'left({c}, (length({c}) - strpos(reverse({c}), {chr(39)}{s[::-1]}{chr(39)}) - {len(s)} + 1)::INT)')}"
        for s in K.TITLE_SEPARATORS
    )
    return f"CASE {cases} ELSE {c} END"


_TITLES = f"SELECT page_id, url, html, {_trim(_decode(_TITLE_RAW))} AS t FROM pages"

#: A page's article as SQL: paragraphs and heading in order, with bold runs that are never closed.
_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"



def _drop_tags(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]*>', '', 'g')"


def _inline(c: str) -> str:
    """A text with marks for tags (chr(1) to chr(4)) as Markdown: every text node is escaped by itself."""
    special = f"regexp_replace({c}, '([\\\\*_`\\[\\]#>~])', '\\\\\\1', 'g')"
    return f"regexp_replace({special}, '(^|[\\x01-\\x04])({_WS}*)([-+]|[0-9]+\\.) ', '\\1\\2\\\\\\3 ', 'g')"


def _article_markdown() -> str:
    """What follows the heading: bold runs are never closed, so every one ends with the article."""
    out = f"regexp_extract({_ARTICLE}, '(?s)</h1>(.*)', 1)"
    for tag, mark in (("<p><b>", 1), ("<br>", 2), ("</p>", 3), ("<p>", 4)):
        out = f"replace({out}, '{tag}', chr({mark}))"
    out = f"regexp_replace({_inline(_collapse(_decode(out)))}, '[\\x02\\x03\\x04 ]+$', '')"
    gap = "chr(10) || chr(10)"
    for marks, text in (("chr(3) || chr(4)", gap), ("chr(2) || chr(4)", f"'  ' || {gap}"), ("chr(3) || chr(1)", f"{gap} || '**'"), ("chr(1)", "'**'")):
        out = f"replace({out}, {marks}, {text})"
    return f"{out} || repeat('**', len(string_split({_ARTICLE}, '<b>')) - 1)"


def _pages_as_extracted(h1_gone: str, ad_gone: str, selected: str) -> str:
    """page_id, markdown, text of every page.  The article wins; an advert before it stays if it is a paragraph of 80
    characters, or if the article is short of 500, unless a rule removes it or selects the article."""
    ad = _decode("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")
    return f"""
      SELECT page_id, html, url, CASE WHEN with_ad THEN {_trim(_inline(_collapse("ad")))} || chr(10) || chr(10) ELSE '' END
        || CASE WHEN h1_gone THEN '' ELSE '# ' || {_escape(_collapse("h1"))} || chr(10) || chr(10) END || rest || chr(10) AS markdown,
        CASE WHEN with_ad THEN ad ELSE '' END || article AS text
      FROM (SELECT *, NOT selected AND NOT ad_gone AND {_trim("ad")} <> '' AND (length(ad) >= 80 OR length({_trim("article")}) < 500) AS with_ad
        FROM (SELECT *, CASE WHEN h1_gone THEN '' ELSE h1 END || {_decode(_drop_tags(f"regexp_extract({_ARTICLE}, '(?s)</h1>(.*)', 1)"))} AS article
          FROM (SELECT page_id, html, url, {ad} AS ad, {_decode(_H1_RAW)} AS h1, {_article_markdown()} AS rest, {h1_gone} AS h1_gone, {ad_gone} AS ad_gone, {selected} AS selected FROM pages)))
    """


# ── extraction ──


@query(f"""
SELECT page_id, {_cut_title('t')} AS title, NULL::VARCHAR AS byline, NULL::VARCHAR AS site_name, {_trim(_collapse(f"left({_trim('text')}, 200)"))} AS excerpt, markdown
FROM (SELECT *, {_trim(_decode(_TITLE_RAW))} AS t FROM ({_pages_as_extracted("false", "false", "false")}))
""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over all pages."""
    return P.html_to_markdown(table(spark, sf_dir, "pages")).drop("error")


@query(f"SELECT page_id, {_cut_title('t')} AS title FROM ({_TITLES})")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html_to_markdown(table(spark, sf_dir, "pages"), fields=("title",)).select("page_id", "title")


@query("""
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS byline, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS site_name FROM customer
""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written from customers: the author in a meta element, in an element of class byline, or nowhere."""
    key = F.col("c_custkey")
    author = F.when(key % 3 == 0, F.concat(F.lit("<meta name=author content='"), "c_name", F.lit("'>"))).otherwise("")
    byline = F.when(key % 3 == 1, F.concat(F.lit("<div class='post byline'> "), "c_name", F.lit(" </div>"))).otherwise("")
    site = F.when(key % 2 == 0, F.concat(F.lit('<meta property="og:site_name" content="'), "c_mktsegment", F.lit('">'))).otherwise("")
    html = F.concat(F.lit("<html><head>"), author, site, F.lit("</head><body>"), byline, F.lit("<p>Text</p>"))
    made = table(spark, sf_dir, "customer").select(key.alias("page_id"), html.alias("html"))
    return P.metadata(made).select("page_id", "byline", "site_name")


@query(f"SELECT page_id, {_decode(_H1_RAW)} AS text FROM pages")
def text_of_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = domrel.dealt(P.html_nodes(table(spark, sf_dir, "pages")))
    return domrel.text_content(domrel.first_by_tag(nodes, "h1"), nodes).select("page_id", "text")


@query(f"""
SELECT page_id, {_trim(_collapse(f"left({_trim(_decode('a'))}, 200)"))} AS excerpt FROM (
  SELECT page_id, regexp_replace({_ARTICLE}, '<[^>]*>', '', 'g') AS a FROM pages)
""")
def page_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a site-wide selection the article is taken as it is; its excerpt joins blocks without a gap."""
    return P.html_to_markdown(table(spark, sf_dir, "pages"), Options(select="article"), fields=("excerpt",)).select("page_id", "excerpt")


@query(f"""
SELECT page_id, markdown FROM ({_pages_as_extracted("contains(url, 'blog.')", "contains(url, 'example.org')", "contains(url, '/fr/')")})
""")
def page_markdown_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by URL decide what is removed and selected."""
    rules = (SiteRule("example.org", remove=(".ad",)), SiteRule("/fr/", select="article"), SiteRule("blog.", remove=("h1",), include=(".ad",)))
    return P.html_to_markdown(table(spark, sf_dir, "pages"), Options(site_rules=rules), fields=("markdown",), url_column="url").select("page_id", "markdown")


@query(f"""
SELECT page_id, markdown FROM ({_pages_as_extracted("regexp_matches(url, '/(de|en)/')", "regexp_matches(url, '^https://m[.]')", "false")})
""")
def page_markdown_regex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site rules whose URL is a regular expression."""
    rules = (SiteRule(re.compile(r"^https://m\."), remove=(".ad",)), SiteRule(re.compile("/(de|en)/"), remove=("h1",)))
    return P.html_to_markdown(table(spark, sf_dir, "pages"), Options(site_rules=rules), fields=("markdown",), url_column="url").select("page_id", "markdown")


# ── selection ──


_LINKS = r"""
SELECT page_id, i::INT AS ord, links[i] AS link FROM (
  SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS links FROM pages))
"""


@query(f"SELECT page_id, ord, {_decode('link')} AS html FROM ({_LINKS})")
def nav_links_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_html(table(spark, sf_dir, "pages"), "nav a[href]")


@query(f"""
SELECT page_id, ord, {_trim("'[' || " + _escape(_collapse(_decode("regexp_extract(link, '>([^<]*)<', 1)"))) + " || '](' || " + _decode("regexp_extract(link, 'href=\"([^\"]*)\"', 1)") + " || ')'")} || chr(10) AS markdown
FROM ({_LINKS})
""")
def nav_links_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_markdown(table(spark, sf_dir, "pages"), "nav ul li a")


@query(f"SELECT page_id, 1 AS ord, {_trim("'# ' || " + _escape(_collapse(_decode(_H1_RAW))))} || chr(10) AS markdown FROM pages")
def select_h1_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_markdown(table(spark, sf_dir, "pages"), "article h1")


@query(rf"""SELECT page_id, 1 AS ord, {_decode("regexp_extract(html, '(?s)<div class=" + '"ad"' + ">.*?</div>')")} AS html FROM pages""")
def select_ad_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_html(table(spark, sf_dir, "pages"), "div.ad[class=ad]")


@query(f"""
SELECT p.page_id, CASE WHEN n IS NULL THEN 'No elements matched selector: nav a' ELSE 'Found ' || n || ' element(s) matching "nav a":' || chr(10) || chr(10) || listed END AS text
FROM pages p LEFT JOIN (
  SELECT page_id, count(*) AS n, string_agg('[' || ord || '] ' || {_decode('link')}, chr(10) || chr(10) ORDER BY ord) AS listed FROM ({_LINKS}) GROUP BY page_id
) l ON l.page_id = p.page_id
""")
def tool_select_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return P.select_response(pages, P.select_html(pages, "nav a"), "nav a")


@query(f"""
SELECT p.page_id, CASE WHEN n IS NULL THEN 'No elements matched selector: nav a' ELSE 'Found ' || n || ' element(s) matching "nav a":' || chr(10) || chr(10) || listed END AS text
FROM pages p LEFT JOIN (
  SELECT page_id, count(*) AS n, string_agg('[' || ord || ']' || chr(10) || markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS listed FROM ({ORACLES["nav_links_md"]}) GROUP BY page_id
) l ON l.page_id = p.page_id
""")
def tool_select_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return P.select_response(pages, P.select_markdown(pages, "nav a"), "nav a", "markdown")


@query(f"SELECT page_id, CASE WHEN title = '' THEN 'x' ELSE '# ' || title || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'x' END AS text FROM (SELECT page_id, {_cut_title('t')} AS title FROM ({_TITLES}))")
def tool_convert_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response's head over a fixed body."""
    made = P.html_to_markdown(table(spark, sf_dir, "pages"), fields=("title", "byline", "site_name"))
    return P.convert_response(made.withColumn("markdown", F.lit("x")))


# ── the document as a table ──

_BARE = r"regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script></script>', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query(rf"""
SELECT page_id, tag, count(*)::BIGINT AS n FROM (
  SELECT page_id, lower(regexp_extract(t, '^<([a-zA-Z0-9]+)', 1)) AS tag FROM (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<[a-zA-Z][^>]*>')) AS t FROM pages)
) GROUP BY page_id, tag
""")
def node_counts_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.html_nodes(table(spark, sf_dir, "pages"))
    return domrel.elements(nodes).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS data FROM pages")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html_nodes(table(spark, sf_dir, "pages")).filter("kind = 'comment'").select("page_id", "data")


@query(rf"""
SELECT page_id, kind, count(*)::BIGINT AS n FROM (
  SELECT page_id, unnest(regexp_extract_all({_BARE}, '<[a-zA-Z/][^>]*>')) AS t FROM pages
) JOIN (VALUES ('start'), ('end')) k(kind) ON (kind = 'end') = starts_with(t, '</') GROUP BY page_id, kind
""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.html_tokens(table(spark, sf_dir, "pages")).filter(F.col("kind").isin("start", "end"))
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query(rf"SELECT page_id, {_decode("regexp_extract(html, '(?s)<div class=" + '"ad"' + ">(.*?)</div>', 1)")} AS text FROM pages")
def text_of_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = domrel.dealt(P.html_nodes(table(spark, sf_dir, "pages")))
    return domrel.text_content(domrel.select(nodes, "body .ad"), nodes).select("page_id", "text")


@query(f"""
SELECT page_id, sum(length(t))::BIGINT AS text_length, sum(length(t))::BIGINT AS link_length, CASE WHEN sum(length(t)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS density
FROM (SELECT page_id, {_decode("regexp_extract(link, '>([^<]*)<', 1)")} AS t FROM ({_LINKS})) GROUP BY page_id
""")
def link_density_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = domrel.dealt(P.html_nodes(table(spark, sf_dir, "pages")))
    return domrel.link_density(domrel.by_tag(nodes, "nav"), nodes).drop("node_id")


@query(rf"""
SELECT page_id, count(*)::BIGINT AS n FROM (
  SELECT page_id, lower(regexp_extract(t, '^<([a-zA-Z0-9]+)', 1)) AS tag FROM (
    SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace({_BARE}, '(?s)<nav>.*?</nav>', ''), '(?s)<footer>.*?</footer>', ''), '<[a-zA-Z][^>]*>')) AS t FROM pages)
) WHERE tag NOT IN ('script', 'style') GROUP BY page_id
""")
def stripped_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when stripped elements go, by an anti-join on intervals."""
    nodes = domrel.dealt(P.html_nodes(table(spark, sf_dir, "pages")))
    return domrel.elements(domrel.strip(nodes)).groupBy("page_id").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS page_id, k AS number, CASE WHEN k = 2 OR k <= 1 AND (p_size + k) % 3 = 0 THEN 'div' ELSE 'p' END AS tag
FROM part, (VALUES (0), (1), (2)) t(k)
""")
def div_to_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divs written from parts: some hold a list, others only inline elements; the third holds the other two."""
    inner = lambda k: F.concat(F.lit(f"<div id=d{k}>"), F.when((F.col("p_size") + k) % 3 == 0, "<ul><li>a</ul>").otherwise("<span>a</span> <em>b</em>"), F.lit("</div>"))
    html = F.concat(F.lit("<div id=d2>"), inner(0), inner(1), F.lit("</div>"))
    nodes = P.html_nodes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    of = F.get(F.filter("attrs", lambda a: a["name"] == "id"), F.lit(0))["value"]
    found = domrel.divs_to_paragraphs(nodes).withColumn("of", of).filter("of is not null")
    return found.select("page_id", F.substring("of", 2, 1).cast("int").alias("number"), "tag")


@query("""
SELECT c_custkey AS page_id, tag, parent_tag, depth, (CASE WHEN tag = 'li' THEN 1 + c_custkey % 4 ELSE n END)::BIGINT AS n
FROM customer, (VALUES ('ul', '', 1, 1), ('li', 'ul', 2, 0), ('p', 'li', 3, 2), ('table', '', 1, 1), ('tbody', 'table', 2, 1), ('tr', 'tbody', 3, 2), ('td', 'tr', 4, 3), ('b', '', 1, 1))
  t(tag, parent_tag, depth, n)
""")
def nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and tables written from customers without end tags or tbody, with a stray end tag: who lies in whom."""
    items = F.repeat(F.concat(F.lit("<li>"), "c_name"), (1 + F.col("c_custkey") % 4).cast("int"))
    html = F.concat(F.lit("<!DOCTYPE html><ul>"), items, F.lit("<p>x<p>y</ul><table><tr><td>"), "c_mktsegment", F.lit("<td>b<tr><td>c</table></i><b>z</p></b>"))
    nodes = domrel.dealt(P.html_nodes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))))
    above = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.coalesce("tag", F.lit("")).alias("parent_tag"))
    # Spark takes the nodes for as small as the table they are written from, and would broadcast all of them
    found = domrel.elements(nodes).join(above.hint("merge"), ["page_id", "parent_id"])
    return found.groupBy("page_id", "tag", "parent_tag", "depth").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS page_id, (CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 4 END)::BIGINT AS n FROM customer")
def unlikely_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements left of pages written from customers: a sidebar goes with its inside, one that is also named article stays."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "sidebar").when(key % 3 == 1, "sidebar article").otherwise("plain")
    html = F.concat(F.lit("<body><div class='"), name, F.lit("'><p>"), "c_name", F.lit("</p></div><p>k</p></body>"))
    nodes = domrel.dealt(P.html_nodes(table(spark, sf_dir, "customer").select(key.alias("page_id"), html.alias("html"))))
    return domrel.elements(domrel.drop_unlikely(nodes)).groupBy("page_id").agg(F.count("*").alias("n"))


def _score(c: str) -> str:
    return f"CASE WHEN length({c}) >= 25 THEN 1 + length({c}) - length(replace(replace({c}, ',', ''), '、', '')) + least(length({c}) // 100, 3) END"


@query(f"""
SELECT page_id, CASE WHEN coalesce(article > body, article IS NOT NULL) THEN 'article' ELSE 'body' END AS tag, round(coalesce(greatest(article, body), article, body), 6)::DOUBLE AS final_score
FROM (SELECT page_id, 5 + p AS article, coalesce(p / 2, 0) + coalesce(a, 0) AS body, coalesce(p, a) AS any_score
  FROM (SELECT page_id, {_score('p')} AS p, {_score('a')} AS a
    FROM (SELECT page_id, {_decode(_drop_tags(f"regexp_extract({_ARTICLE}, '(?s)</h1>(.*)', 1)"))} AS p, {_decode("regexp_extract(html, '(?s)<div class=" + '"ad"' + ">(.*?)</div>', 1)")} AS a FROM pages)))
WHERE any_score IS NOT NULL
""")
def top_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring and ranking as joins and windows over nodes."""
    nodes = domrel.dealt(domrel.divs_to_paragraphs(domrel.strip(domrel.dealt(P.html_nodes(table(spark, sf_dir, "pages"))))))
    return domrel.top_candidates(nodes).select("page_id", "tag", F.round("final_score", 6).alias("final_score"))


# ── flat text, native ──


@query(f"SELECT doc_id, {_escape(_collapse('text'))} AS text FROM documents")
def md_escape_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.md_escape(N.collapse_ws("text")).alias("text"))


@query(f"SELECT doc_id, {_collapse('text')} AS text FROM documents")
def collapse_ws_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.collapse_ws("text").alias("text"))


@query(f"SELECT doc_id, {_trim(_collapse(f'left({_trim("text")}, 200)'))} AS excerpt FROM documents")
def excerpt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.excerpt("text").alias("excerpt"))


@query("SELECT doc_id, (1 + length(text) - length(replace(replace(text, ',', ''), '、', '')) + least(length(text) // 100, 3))::INT AS score FROM documents")
def paragraph_score_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.paragraph_score("text").cast("int").alias("score"))


_CLASSES = [(c,) for c in ("article main", "sidebar ad", "post-body comment", "MAIN", "hid x", "plain", "story", "brand", "com-x", "Widget page", "footer", "Menu")]


@query(f"""
SELECT c AS names, ((CASE WHEN regexp_matches(c, '{K.word_pattern(K.POSITIVE_WORDS)}', 'i') THEN 25 ELSE 0 END)
  - (CASE WHEN regexp_matches(c, '{K.word_pattern(K.NEGATIVE_WORDS)}', 'i') THEN 25 ELSE 0 END))::INT AS weight FROM {_values([(f"{c} ",) for (c,) in _CLASSES])} t(c)
""")
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(f"{c} ",) for (c,) in _CLASSES], "names string")
    return rows.select("names", N.class_weight("names").alias("weight"))


_TAGS = [(t,) for t in "div article section pre td blockquote address ul ol dl dd li form h1 h2 h3 h4 h5 h6 th p span html body".split()]


@query(f"""
SELECT t AS tag, (CASE WHEN t IN ('div', 'article', 'section') THEN 5 WHEN t IN ('pre', 'td', 'blockquote') THEN 3
  WHEN t IN ('address', 'ul', 'ol', 'dl', 'dd', 'li', 'form') THEN -3 WHEN t IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'th') THEN -5 ELSE 0 END)::INT AS score FROM {_values(_TAGS)} x(t)
""")
def base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_TAGS, "tag string").select("tag", N.base_score("tag").alias("score"))


# ── rules and robots ──

_RULES = (SiteRule("example.org", remove=(".ad",)), SiteRule("/fr/", include=("p",), select="article"), SiteRule("https://", remove=("footer", "nav"), select="body"))


@query(f"""
SELECT page_id, url, coalesce(array_to_string(flatten(list(CASE WHEN remove = '' THEN [] ELSE string_split(remove, ',') END ORDER BY ord) FILTER (fit)), ','), '') AS remove,
  coalesce(array_to_string(flatten(list(CASE WHEN include = '' THEN [] ELSE string_split(include, ',') END ORDER BY ord) FILTER (fit)), ','), '') AS include,
  min_by(sel, ord) FILTER (fit AND sel IS NOT NULL) AS "select"
FROM (SELECT page_id, url, r.*, contains(url, r.part) AS fit FROM pages, {_values([(i, r.url, ",".join(r.remove), ",".join(r.include), r.select) for i, r in enumerate(_RULES)])} r(ord, part, remove, include, sel))
GROUP BY page_id, url
""")
def site_rules_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.resolve(table(spark, sf_dir, "pages"), S.rules_table(spark, _RULES))
    joined = lambda c: F.when(F.size("remove") + F.size("include") >= 0, F.array_join(c, ",")).alias(c)
    return found.select("page_id", "url", joined("remove"), joined("include"), "select")


#: One site forbids a language, one all but a path, one names another agent.
_ROBOTS = (
    ("example.com", "User-agent: *\nDisallow: /en/\nAllow: /en/1\n"),
    ("example.net", "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*.html$\nDisallow: /*?utm_\n"),
    ("example.org", "User-agent: webdistill\nDisallow: /\nAllow: /de/\nAllow: /fr/\n"),
)


@query(r"""
SELECT page_id, url, CASE
  WHEN host LIKE '%.example.com' THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/1')
  WHEN host LIKE '%.example.net' THEN NOT (regexp_matches(path, '^/.*\.html$') OR regexp_matches(path, '^/.*\?utm_'))
  WHEN host LIKE '%.example.org' THEN starts_with(path, '/de/') OR starts_with(path, '/fr/') ELSE true END AS allowed
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages)
""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return R.decide(pages, _held(spark, pages))


def _held(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Each site's hosts share its robots.txt."""
    bodies = spark.createDataFrame(_ROBOTS, "site string, body string")
    origins = pages.select(N.url_origin("url").alias("origin")).distinct()
    return origins.join(F.broadcast(bodies), F.col("origin").endswith(F.concat(F.lit("."), F.col("site")))).select("origin", "body")


@query(f"SELECT page_id, url FROM ({ORACLES['robots_allowed']}) WHERE allowed")
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pages that may be read."""
    pages = table(spark, sf_dir, "pages")
    return R.gate(pages, _held(spark, pages)).select("page_id", "url")


@query(f"SELECT page_id, NOT allowed AS robots_blocked FROM ({ORACLES['robots_allowed']})")
def robots_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with what robots.txt says beside them."""
    pages = table(spark, sf_dir, "pages")
    return R.gate(pages, _held(spark, pages), force=True).select("page_id", "robots_blocked")


@query(_values([("a", 1, "disallow", "/x"), ("a", 1, "allow", "/x/y"), ("a", 2, "disallow", "/"), ("b", 1, "disallow", "/z")]).replace("(VALUES", "SELECT * FROM (VALUES") + " t(origin, group_no, type, path)")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = [("a", "# c\nUser-agent: *\nDisallow: /x # why\nAllow: /x/y\nDisallow:\n\nUser-Agent: Bot\nuser-agent: other\nDISALLOW: /\nSitemap: s\n"), ("b", "Disallow: /z\nnonsense\n")]
    rules = R.robots_rules(spark.createDataFrame(bodies, "origin string, body string"))
    return rules.filter("path is not null").select("origin", F.col("group_no").cast("int").alias("group_no"), "type", "path")


# ── rendering HTML written from relational rows ──


def _rendered(rows: DataFrame, html, **style: str) -> DataFrame:
    return P.render_html(rows.withColumn("html", html), "html", markdown=MarkdownOptions.of(**style)).drop("html")


def _row(*cells: str) -> F.Column:
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))], F.lit("</tr>"))


@query("""
WITH n AS (SELECT n_regionkey, n_nationkey::VARCHAR AS k, replace(n_name, '_', '\\_') AS v FROM nation), w AS (
  SELECT n_regionkey, greatest(3, max(length(k))) AS a, greatest(4, max(length(v))) AS b FROM n GROUP BY n_regionkey)
SELECT n.n_regionkey, '| ' || rpad('key', any_value(a)::INT, ' ') || ' | ' || rpad('name', any_value(b)::INT, ' ') || ' |' || chr(10)
  || '| ' || repeat('-', any_value(a)::INT) || ' | ' || repeat('-', any_value(b)::INT) || ' |' || chr(10)
  || string_agg('| ' || rpad(k, a::INT, ' ') || ' | ' || rpad(v, b::INT, ' ') || ' |', chr(10) ORDER BY k::INT) || chr(10) AS markdown
FROM n JOIN w ON w.n_regionkey = n.n_regionkey GROUP BY n.n_regionkey
""")
def gfm_table_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("row", _row("n_nationkey", "n_name"))
    rows = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "").alias("rows"))
    return _rendered(rows, F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), "rows", F.lit("</table>"))).select("n_regionkey", "markdown")


@query("SELECT string_agg((r_regionkey + 1) || '. ' || r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS markdown FROM region")
def ordered_list_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: F.concat(F.lit("<li>"), x["r_name"], F.lit("</li>"))), "")
    rows = table(spark, sf_dir, "region").agg(items.alias("items"))
    return _rendered(rows, F.concat(F.lit("<ol>"), "items", F.lit("</ol>"))).select("markdown")


@query("SELECT r_regionkey, '* ' || r_name || chr(10) || '* key ' || r_regionkey || chr(10) AS markdown FROM region")
def bullet_list_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<ul><li>"), "r_name", F.lit("</li><li>key "), F.col("r_regionkey").cast("string"), F.lit("</li></ul>"))
    return _rendered(table(spark, sf_dir, "region"), html, bullet_list_marker="*").select("r_regionkey", "markdown")


@query("SELECT n_nationkey, replace(n_name, '_', '\\_') || chr(10) || repeat('=', length(replace(n_name, '_', '\\_'))) || chr(10) || chr(10) || '## ' || n_nationkey || chr(10) AS markdown FROM nation")
def heading_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setext for the first two levels would underline both; the second is written as a third level."""
    html = F.concat(F.lit("<h1>"), "n_name", F.lit("</h1>"))
    setext = _rendered(table(spark, sf_dir, "nation"), html, heading_style="setext").withColumnRenamed("markdown", "upper")
    both = P.render_html(setext.withColumn("html", F.concat(F.lit("<h2>"), F.col("n_nationkey").cast("string"), F.lit("</h2>"))), "html")
    return both.select("n_nationkey", F.concat("upper", F.lit("\n"), "markdown").alias("markdown"))


@query("SELECT n_nationkey, '> ' || replace(n_name, '_', '\\_') || chr(10) || '> ' || chr(10) || '> ' || chr(10) || '> ' || chr(10) || '> ' || n_nationkey || chr(10) AS markdown FROM nation")
def blockquotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<blockquote><p>"), "n_name", F.lit("</p><p>"), F.col("n_nationkey").cast("string"), F.lit("</p></blockquote>"))
    return _rendered(table(spark, sf_dir, "nation"), html).select("n_nationkey", "markdown")


@query("SELECT p_partkey, '**' || replace(p_brand, '#', '\\#') || '** _' || p_type || '_ [' || p_name || '](/p/' || p_partkey || ' \"t\")![' || p_size || '](/i.png)' || chr(10) AS markdown FROM part")
def inline_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<p><b>"), "p_brand", F.lit("</b> <em> "), "p_type", F.lit(" </em> <a href=/p/"), key, F.lit(" title='t'>"), "p_name",
        F.lit("</a><img data-src=/i.png alt="), F.col("p_size").cast("string"), F.lit("></p>"),
    )
    return _rendered(table(spark, sf_dir, "part"), html, em_delimiter="_").select("p_partkey", "markdown")


@query("SELECT o_orderkey, '```sql' || chr(10) || 'select *' || chr(10) || ' from o_' || o_orderkey || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) AS markdown FROM orders")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    html = F.concat(F.lit('<pre><code class="x language-sql">select *\n from o_'), key, F.lit("</code></pre><hr>"))
    return _rendered(table(spark, sf_dir, "orders").select("o_orderkey"), html).select("o_orderkey", "markdown")


@query("SELECT p_partkey, 'use ' || CASE p_size % 3 WHEN 0 THEN '`' || p_name || '`' WHEN 1 THEN '``' || p_name || '\\`' || p_size || '``' ELSE '``\\`' || p_name || '``' END || ' now' || chr(10) AS markdown FROM part")
def inline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code without a backtick, with one inside, and with one at its start; its text is escaped like other text."""
    code = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("`"), "p_size")).otherwise(F.concat(F.lit("`"), "p_name"))
    html = F.concat(F.lit("<p>use <code>"), code, F.lit("</code> now</p>"))
    return _rendered(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), html).select("p_partkey", "markdown")


@query("""
SELECT p_partkey, '```' || chr(10) || p_type || chr(10) || '  ' || p_brand || chr(10) || '```' || chr(10) || chr(10) || replace(p_brand, '#', '\\#') || '  ' || chr(10) || p_size || chr(10) || chr(10)
  || '![' || p_size || '](/' || p_partkey || '.png)' || chr(10) || '*' || p_name || '*' || chr(10) || chr(10) || 'az ' || p_type || chr(10) || chr(10) || p_name || ' ' || p_size || chr(10) AS markdown
FROM part
""")
def blocks_and_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain pre, br, figure with caption, comment, CDATA and elements without a rule, written from parts."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    html = F.concat(
        F.lit("<pre>"), "p_type", F.lit("\n  "), "p_brand", F.lit("</pre><p>"), "p_brand", F.lit("<br>"), size, F.lit("</p><figure><img src=/"), key, F.lit(".png alt="), size,
        F.lit("><figcaption>"), "p_name", F.lit("</figcaption></figure><p>a<!-- "), "p_name", F.lit(" -->z <![CDATA["), "p_type", F.lit("]]></p><section><del>"), "p_name",
        F.lit("</del> <sup>"), size, F.lit("</sup></section>"),
    )
    return _rendered(table(spark, sf_dir, "part"), html).select("p_partkey", "markdown")


@query("SELECT user_id, count(*)::BIGINT AS n, min(md) AS first, max(md) AS last FROM (SELECT user_id, 'k' || replace(event_type, '_', '\\_') || ' ' || event_id || chr(10) AS md FROM events) GROUP BY user_id")
def fragments_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment of each event rendered; each user's first and last."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    made = _rendered(events, F.concat(F.lit("<div>k"), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("</div>")))
    return made.groupBy("user_id").agg(F.count("*").alias("n"), F.min("markdown").alias("first"), F.max("markdown").alias("last"))
