"""DataFrame operators over pages(page_id, url, html).

All are row-local: one Arrow-batched Python stage, no shuffle, so the plan is the same for a hundred
pages and for a hundred terabytes.  mapInArrow keeps the stage opaque: a filter on a result column can't
make Catalyst run the kernel twice.  Only the columns the kernel needs are read.

A page that fails never fails the job: html_to_markdown's `error` says why, html_nodes and html_tokens give one
row of kind error, selections one row with ord 0 and no match, render_html null.  Null html is an empty page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.text import sound
from ..kernel.distill import FIELDS, ExtractOptions, distill
from ..kernel.dom import node_rows, parse
from ..kernel.render import MarkdownOptions, Renderer, Rule
from ..kernel.scan import tokens
from ..kernel.select import compile_selector, select_all
from ..kernel.serialize import to_html

_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
NODES = (
    "page_id long, node_id int, parent_id int, end_id int, depth int, sib_pos int, kind string, tag string, "
    "attrs array<struct<name: string, value: string>>, data string"
)
TOKENS = "page_id long, ord int, kind string, name string, attrs array<struct<name: string, value: string>>, self_closing boolean, data string"


def _arrow(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _expand(per_page: Callable[[str], list[tuple]], schema: pa.Schema, failed: Callable[[str], tuple], most: int = 50_000):
    """Rows of every page, or the one that says why there are none; flushed whenever `most` are gathered, so that no
    batch grows with the page count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                try:
                    rows += [(page, *r) for r in per_page(html or "")]
                except Exception as e:  # one page's trouble is a row, not the job's end
                    rows.append((page, *failed(f"{type(e).__name__}: {e}")))
                if len(rows) >= most:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    return run


def _pages(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    return pages.select(pages[id_column].cast("long").alias("page_id"), pages[html_column].alias("html"))


def html_to_markdown(
    pages: DataFrame, options: Options | None = None, *, fields: tuple[str, ...] = FIELDS, rules: tuple[Rule, ...] = (),
    id_column: str = "page_id", html_column: str = "html", url_column: str | None = None,
) -> DataFrame:
    """page_id, the wanted fields, error.  With url_column the options' site rules apply by URL.

    Asking for metadata only skips scoring and rendering.
    """
    o = options or Options()
    base = replace(o.extract(), rules=tuple(rules))
    for text in (*base.remove, *base.include, *([base.select] if base.select else [])):
        compile_selector(text)
    for r in o.site_rules:
        for text in (*r.remove, *r.include, *([r.select] if r.select else [])):
            compile_selector(text)
    site_rules = o.site_rules if url_column else ()
    read = pages.select(
        pages[id_column].cast("long").alias("page_id"), pages[html_column].alias("html"), *([pages[url_column].alias("url")] if site_rules else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..config import resolve_for

        known: dict[tuple[int, ...], ExtractOptions] = {}
        for batch in batches:
            urls = batch.column("url").to_pylist() if site_rules else [None] * batch.num_rows
            out: dict[str, list] = {f: [] for f in (*fields, "error")}
            for html, url in zip(batch.column("html").to_pylist(), urls, strict=True):
                mine = base
                if site_rules:
                    key = tuple(i for i, r in enumerate(site_rules) if url is not None and r.fits(url))
                    if key not in known:
                        known[key] = replace(resolve_for(url, o).extract(), rules=base.rules)
                    mine = known[key]
                try:
                    page, error = distill(html or "", mine, fields), None
                except Exception as e:  # one page's trouble is a value, not the job's end
                    page, error = None, f"{type(e).__name__}: {e}"
                for f in fields:
                    value = getattr(page, f) if page else None
                    out[f].append(sound(value) if value is not None and any("\ud800" <= c <= "\udfff" for c in value) else value)
                out["error"].append(error)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(v, pa.string()) for v in out.values()]], names=["page_id", *out])

    return read.mapInArrow(run, ", ".join(["page_id long", *[f"{f} string" for f in fields], "error string"]))


def metadata(pages: DataFrame, **where: str) -> DataFrame:
    """page_id, title, byline, site_name, error."""
    return html_to_markdown(pages, fields=("title", "byline", "site_name"), **where)


def html_nodes(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The parsed document as rows: node_id in document order, end_id the last node of the subtree."""
    schema = _arrow([("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "parent_id", "end_id", "depth", "sib_pos")], ("kind", pa.string()), ("tag", pa.string()), ("attrs", _ATTRS), ("data", pa.string())])

    def rows(html: str) -> list[tuple]:
        return [(*r[:7], [{"name": k, "value": v} for k, v in r[7]], r[8]) for r in node_rows(parse(html))]

    return _pages(pages, id_column, html_column).mapInArrow(_expand(rows, schema, lambda e: (0, None, 0, 0, 0, "error", None, [], e)), NODES)


def html_tokens(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The scanner's tokens in order; the last is always of kind eof."""
    schema = _arrow([("page_id", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("attrs", _ATTRS), ("self_closing", pa.bool_()), ("data", pa.string())])

    def rows(html: str) -> list[tuple]:
        found = [(i, t.kind, t.name or None, [{"name": k, "value": v} for k, v in t.attributes], t.self_closing, t.data if t.kind in ("text", "comment") else None) for i, t in enumerate(tokens(html))]
        return [*found, (len(found), "eof", None, [], False, None)]

    return _pages(pages, id_column, html_column).mapInArrow(_expand(rows, schema, lambda e: (0, "error", None, [], False, e)), TOKENS)


def select_html(pages: DataFrame, selector: str, *, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """page_id, ord (from 1), html of every match in document order."""
    compile_selector(selector)
    schema = _arrow([("page_id", pa.int64()), ("ord", pa.int32()), ("html", pa.string())])

    def rows(html: str) -> list[tuple]:
        tree = parse(html)
        return [(i, to_html(tree, x)) for i, x in enumerate(select_all(tree, 0, selector), 1)]

    return _pages(pages, id_column, html_column).mapInArrow(_expand(rows, schema, lambda e: (0, None)), "page_id long, ord int, html string")


def select_markdown(
    pages: DataFrame, selector: str, markdown: MarkdownOptions | None = None, *, rules: tuple[Rule, ...] = (),
    id_column: str = "page_id", html_column: str = "html",
) -> DataFrame:
    """page_id, ord (from 1), markdown of every match; nothing is cleaned."""
    compile_selector(selector)
    schema = _arrow([("page_id", pa.int64()), ("ord", pa.int32()), ("markdown", pa.string())])

    def rows(html: str) -> list[tuple]:
        tree, renderer = parse(html), Renderer(markdown, rules)
        return [(i, renderer.render(tree, x)) for i, x in enumerate(select_all(tree, 0, selector), 1)]

    return _pages(pages, id_column, html_column).mapInArrow(_expand(rows, schema, lambda e: (0, None)), "page_id long, ord int, markdown string")


def _rendered(renderer: Renderer, html: str | None) -> str | None:
    try:
        return None if html is None else renderer.render(parse(html), 0)
    except Exception:  # as for a null
        return None


def render_html(rows: DataFrame, html_column: str, *, markdown: MarkdownOptions | None = None, rules: tuple[Rule, ...] = (), name: str = "markdown") -> DataFrame:
    """Adds the Markdown of a fragment of HTML without extraction."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{name}` string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer = Renderer(markdown, rules)
        for batch in batches:
            made = [_rendered(renderer, h) for h in batch.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(kinds))


# ── responses of the tools, native ──


def convert_response(distilled: DataFrame) -> DataFrame:
    """page_id, text: title, author and site above a rule, then the Markdown."""
    line = lambda head, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    meta = F.concat_ws("\n", line("# ", "title"), line("Author: ", "byline"), line("Site: ", "site_name"))
    return distilled.select("page_id", F.when(meta != "", F.concat(meta, F.lit("\n\n---\n\n"), "markdown")).otherwise(F.col("markdown")).alias("text"))


def select_response(pages: DataFrame, selected: DataFrame, selector: str, column: str = "html") -> DataFrame:
    """page_id, text: how many elements match and each of them; one line for pages without any."""
    head, gap = (" ", "\n\n") if column == "html" else ("\n", "\n\n---\n\n")
    each = F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]" + head), F.col(column))
    listed = selected.withColumn("each", each).groupBy("page_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "each"))).alias("all")
    )
    out = pages.select("page_id").join(listed, "page_id", "left")
    found = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f' element(s) matching "{selector}":\n\n'), F.array_join(F.transform("all", lambda x: x["each"]), gap))
    return out.select("page_id", F.coalesce(found, F.lit(f"No elements matched selector: {selector}")).alias("text"))
