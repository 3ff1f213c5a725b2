"""The engine's functions by name in Spark SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernel import distill as K
from ..kernel.dom import node_rows, parse
from ..kernel.entities import decode
from ..kernel.render import Renderer, escape_markdown
from ..kernel.robots import is_allowed, parse_robots
from ..kernel.scan import tokens
from ..kernel.select import select_all
from ..kernel.serialize import to_html

_PAGE = "title string, markdown string, excerpt string, byline string, site_name string"
_ATTRS = "array<struct<name: string, value: string>>"


def _pandas(kind: str):
    return F.pandas_udf(returnType=kind)


def register(spark: SparkSession) -> None:
    """html_to_markdown, html_title, md_escape, decode_entities, class_weight, robots_allowed; html_nodes, html_tokens, select_html, select_markdown as table functions."""

    @_pandas(_PAGE)
    def html_to_markdown(html: pd.Series) -> pd.DataFrame:
        pages = [K.distill(h or "") for h in html]
        return pd.DataFrame({f: [getattr(p, f) for p in pages] for f in K.FIELDS})

    @_pandas("string")
    def html_title(html: pd.Series) -> pd.Series:
        return pd.Series([K.distill(h or "", fields=("title",)).title for h in html], dtype=object)

    @_pandas("string")
    def md_escape(text: pd.Series) -> pd.Series:
        return text.map(escape_markdown, na_action="ignore")

    @_pandas("string")
    def decode_entities(text: pd.Series) -> pd.Series:
        return text.map(decode, na_action="ignore")

    @_pandas("int")
    def class_weight(names: pd.Series) -> pd.Series:
        return names.fillna("").map(K.class_weight)

    @_pandas("boolean")
    def robots_allowed(body: pd.Series, agent: pd.Series, path: pd.Series) -> pd.Series:
        known: dict[str, list] = {}
        out = []
        for b, a, p in zip(body, agent, path, strict=True):
            if b not in known:
                known[b] = parse_robots(b or "")
            out.append(is_allowed(known[b], a, p))
        return pd.Series(out)

    for f in (html_to_markdown, html_title, md_escape, decode_entities, class_weight, robots_allowed):
        spark.udf.register(f.__name__, f)

    @F.udtf(returnType=f"node_id int, parent_id int, end_id int, depth int, sib_pos int, kind string, tag string, attrs {_ATTRS}, data string")
    class HtmlNodes:
        def eval(self, html: str) -> Iterator[tuple]:
            yield from node_rows(parse(html or ""))

    @F.udtf(returnType=f"ord int, kind string, name string, attrs {_ATTRS}, self_closing boolean, data string")
    class HtmlTokens:
        def eval(self, html: str) -> Iterator[tuple]:
            k = -1
            for k, t in enumerate(tokens(html or "")):
                yield k, t.kind, t.name or None, list(t.attributes), t.self_closing, t.data if t.kind in ("text", "comment") else None
            yield k + 1, "eof", None, [], False, None

    @F.udtf(returnType="ord int, html string")
    class SelectHtml:
        def eval(self, html: str, selector: str) -> Iterator[tuple]:
            tree = parse(html or "")
            yield from enumerate((to_html(tree, x) for x in select_all(tree, 0, selector)), 1)

    @F.udtf(returnType="ord int, markdown string")
    class SelectMarkdown:
        def eval(self, html: str, selector: str) -> Iterator[tuple]:
            tree, renderer = parse(html or ""), Renderer()
            yield from enumerate((renderer.render(tree, x) for x in select_all(tree, 0, selector)), 1)

    for name, f in (("html_nodes", HtmlNodes), ("html_tokens", HtmlTokens), ("select_html", SelectHtml), ("select_markdown", SelectMarkdown)):
        spark.udtf.register(name, f)
