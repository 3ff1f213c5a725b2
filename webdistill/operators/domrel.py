"""Relational operators over nodes (see html_nodes): ancestry is an interval, order is node_id.

d lies below a iff both are of one page and a.node_id < d.node_id <= a.end_id.  Every join has page_id as
its equality, so it is a hash or merge join with the interval as the residual condition; nothing is a
cross join.  Removing elements is an anti-join against the intervals of what is removed.

html_nodes parses when it is read, so operators that read the nodes more than once should be given
dealt(nodes): parsed once, dealt by page, so that no join on page_id moves them again.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native as N
from ..functions.text import JAVA_WS
from ..kernel import distill as K
from ..kernel.select import Compound, compile_selector


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; our own in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webdistill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def dealt(nodes: DataFrame) -> DataFrame:
    """The nodes dealt and sorted by page_id, kept in the shared folder.  Runs a job: pages are parsed here and never again.

    A reliable checkpoint keeps its partitioning and order, so interval joins, windows and sums by page_id
    read it without an exchange.  One page's nodes are bounded by its HTML, so no part is hot."""
    spark = nodes.sparkSession
    spark.sparkContext.setCheckpointDir(_shared_folder(spark))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan doesn't tell how its result is dealt
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return nodes.repartition(parts, "page_id").sortWithinPartitions("page_id", "node_id").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "element")


def by_tag(nodes: DataFrame, *tags: str) -> DataFrame:
    return elements(nodes).filter(F.col("tag").isin(*tags))


def first_by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """The first element of a tag of each page."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    return by_tag(nodes, tag).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def _below(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, root_id, ...) for every node below each root, the root left out."""
    r = roots.select(F.col("page_id").alias("r_page"), F.col("node_id").alias("root_id"), F.col("end_id").alias("r_end"))
    on = (F.col("page_id") == F.col("r_page")) & (F.col("node_id") > F.col("root_id")) & (F.col("node_id") <= F.col("r_end"))
    return nodes.join(r, on).drop("r_page", "r_end")


def descendants(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    return _below(roots, nodes)


def ancestors(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, target_id, ...) for every element above each target."""
    t = targets.select(F.col("page_id").alias("t_page"), F.col("node_id").alias("target_id"))
    on = (F.col("page_id") == F.col("t_page")) & (F.col("target_id") > F.col("node_id")) & (F.col("target_id") <= F.col("end_id"))
    return elements(nodes).join(t, on).drop("t_page")


def text_content(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, node_id, text: the text below each root in document order; comments say nothing."""
    texts = _below(roots, nodes.filter(F.col("kind") == "text").select("page_id", "node_id", "data"))
    joined = texts.groupBy("page_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "data"))).alias("parts"))
    joined = joined.select("page_id", F.col("root_id").alias("node_id"), F.array_join(F.transform("parts", lambda x: x["data"]), "").alias("text"))
    return roots.select("page_id", "node_id").join(joined, ["page_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def names(nodes: DataFrame) -> Column:
    return N.names_of(N.attribute("attrs", "class"), N.attribute("attrs", "id"))


def fits(c: Compound) -> Column:
    """A compound selector as a predicate on a node's columns."""
    tests = [F.col("kind") == "element"]
    if c.tag is not None:
        tests.append(F.col("tag") == c.tag)
    if c.id is not None:
        tests.append(F.coalesce(N.attribute("attrs", "id"), F.lit("")) == c.id)
    if c.classes:
        have = F.split(F.coalesce(N.attribute("attrs", "class"), F.lit("")), JAVA_WS + "+")
        tests += [F.array_contains(have, x) for x in c.classes]
    for name, value in c.attributes:
        test = F.exists("attrs", lambda a: a["name"] == name) if value is None else N.attribute("attrs", name) == value  # noqa: B023
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Matching elements: one interval semi-join for each step of descent.

    Working down the chain, an element matches a step if it fits and lies below a match of the step
    before; with descent as the only combinator that is exact.
    """
    chain = compile_selector(selector)
    found = nodes.filter(fits(chain[0]))
    for c in chain[1:]:
        a = found.select(F.col("page_id").alias("a_page"), F.col("node_id").alias("a_id"), F.col("end_id").alias("a_end"))
        on = (F.col("page_id") == F.col("a_page")) & (F.col("node_id") > F.col("a_id")) & (F.col("node_id") <= F.col("a_end"))
        found = nodes.filter(fits(c)).join(a, on, "left_semi")
    return found


def without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes that lie in none of the subtrees of gone."""
    g = gone.select(F.col("page_id").alias("g_page"), F.col("node_id").alias("g_id"), F.col("end_id").alias("g_end"))
    on = (F.col("page_id") == F.col("g_page")) & (F.col("node_id") >= F.col("g_id")) & (F.col("node_id") <= F.col("g_end"))
    return nodes.join(g, on, "left_anti")


def protected(nodes: DataFrame, include: list[str]) -> DataFrame:
    """page_id, node_id of all elements that match or hold a match."""
    found = reduce(DataFrame.unionByName, [select(nodes, s) for s in include])
    up = ancestors(found, nodes).select("page_id", "node_id")
    return found.select("page_id", "node_id").unionByName(up).distinct()


def strip(nodes: DataFrame) -> DataFrame:
    """Without the elements that never hold content."""
    return without(nodes, by_tag(nodes, *sorted(K.STRIPPED)))


def drop_unlikely(nodes: DataFrame, shield: DataFrame | None = None) -> DataFrame:
    """Without elements whose names are unlikely to hold content.  A kept element's inside is judged by itself."""
    odd = elements(nodes).filter(N.is_unlikely(names(nodes)) & ~F.col("tag").isin(*sorted(K.NEVER_UNLIKELY), "html"))
    if shield is not None:
        odd = odd.join(shield, ["page_id", "node_id"], "left_anti")
    return without(nodes, odd)


def divs_to_paragraphs(nodes: DataFrame) -> DataFrame:
    """A div without a block child is called p.  Parents grow with the pages and are merged: Spark takes them for a share of the
    files' size, and would broadcast them."""
    block = by_tag(nodes, *sorted(K.KEEPS_DIV)).select("page_id", F.col("parent_id").alias("node_id")).distinct().withColumn("holds", F.lit(True))
    out = nodes.join(block.hint("merge"), ["page_id", "node_id"], "left")
    return out.withColumn("tag", F.when((F.col("tag") == "div") & F.col("holds").isNull(), F.lit("p")).otherwise(F.col("tag"))).drop("holds").select(*nodes.columns)


def link_density(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, node_id, text_length, link_length, density: text in outermost links below each root."""
    text = nodes.filter(F.col("kind") == "text").select("page_id", "node_id", N.u16_length("data").alias("n"))
    total = _below(roots, text).groupBy("page_id", "root_id").agg(F.sum("n").alias("text_length"))
    links = _below(roots, by_tag(nodes, "a").select("page_id", "node_id", "end_id"))
    # a text counts once, however many links lie round it
    under = links.select(F.col("page_id").alias("l_page"), F.col("root_id").alias("l_root"), F.col("node_id").alias("l_id"), F.col("end_id").alias("l_end"))
    on = (F.col("page_id") == F.col("l_page")) & (F.col("node_id") > F.col("l_id")) & (F.col("node_id") <= F.col("l_end"))
    linked = text.join(under, on).select("page_id", F.col("l_root").alias("root_id"), "node_id", "n").distinct()
    linked = linked.groupBy("page_id", "root_id").agg(F.sum("n").alias("link_length"))
    out = roots.select("page_id", F.col("node_id").alias("root_id")).join(total, ["page_id", "root_id"], "left").join(linked, ["page_id", "root_id"], "left")
    length = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("page_id", F.col("root_id").alias("node_id"), length("text_length"), length("link_length"))
    return out.withColumn("density", F.when(F.col("text_length") > 0, F.col("link_length") / F.col("text_length")).otherwise(F.lit(0.0)))


def paragraph_scores(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, score of outermost p, pre and td with at least 25 units of text."""
    body = first_by_tag(nodes, "body")
    leaves = _below(body, by_tag(nodes, *sorted(K.CONTENT_TAGS))).drop("root_id")
    g = leaves.select(F.col("page_id").alias("g_page"), F.col("node_id").alias("g_id"), F.col("end_id").alias("g_end"))
    inner = (F.col("page_id") == F.col("g_page")) & (F.col("node_id") > F.col("g_id")) & (F.col("node_id") <= F.col("g_end"))
    outer = leaves.join(g, inner, "left_anti")
    text = text_content(outer, nodes).filter(N.u16_length("text") >= 25)
    return text.select("page_id", "node_id", N.paragraph_score("text").alias("score"))


def candidates(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, content_score, first_seen: paragraph scores carried up to six ancestors.

    A parent gets the whole score, the grandparent half, the next a sixth, and so on.
    """
    scored = paragraph_scores(nodes).select(F.col("page_id").alias("t_page"), F.col("node_id").alias("target_id"), "score")
    on = (F.col("page_id") == F.col("t_page")) & (F.col("target_id") > F.col("node_id")) & (F.col("target_id") <= F.col("end_id"))
    up = elements(nodes).join(scored, on)
    w = Window.partitionBy("page_id", "target_id").orderBy(F.col("depth").desc())
    up = up.withColumn("level", F.row_number().over(w) - 1).filter(F.col("level") < len(K.DIVISORS))
    divisor = F.element_at(F.array(*[F.lit(float(d)) for d in K.DIVISORS]), F.col("level") + 1)
    seen = F.struct("target_id", "level")
    own = (N.base_score("tag") + N.class_weight(names(nodes))).alias("own")
    parts = up.select("page_id", "node_id", own, (F.col("score") / divisor).alias("part"), seen.alias("seen"))
    out = parts.groupBy("page_id", "node_id").agg(F.max("own").alias("own"), F.sum("part").alias("sum"), F.min("seen").alias("first_seen"))
    return out.select("page_id", "node_id", (F.col("own") + F.col("sum")).alias("content_score"), "first_seen")


def top_candidates(nodes: DataFrame, k: int = 1) -> DataFrame:
    """The k best candidates of each page by score without links; ties go to the first seen.  Candidates are kept in the
    shared folder, as their density needs them several times."""
    found = dealt(candidates(nodes))
    at = found.join(nodes.select("page_id", "node_id", "end_id", "tag"), ["page_id", "node_id"])
    dense = link_density(at, nodes).select("page_id", "node_id", "density")
    final = at.join(dense, ["page_id", "node_id"]).withColumn("final_score", F.col("content_score") * (1 - F.col("density")))
    w = Window.partitionBy("page_id").orderBy(F.col("final_score").desc(), "first_seen")
    return final.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("page_id", "node_id", "tag", "content_score", "final_score", "rank")


def siblings(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements beside each target: page_id, target_id and the sibling's columns."""
    own = targets.select("page_id", "node_id").join(nodes.select("page_id", "node_id", "parent_id"), ["page_id", "node_id"])
    t = own.select(F.col("page_id").alias("t_page"), F.col("node_id").alias("target_id"), F.col("parent_id").alias("t_parent"))
    on = (F.col("page_id") == F.col("t_page")) & (F.col("parent_id") == F.col("t_parent")) & (F.col("node_id") != F.col("target_id"))
    return elements(nodes).join(t, on).drop("t_page", "t_parent")
