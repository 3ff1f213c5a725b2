"""Which site rules apply to which URLs, as a join over a table of rules.

The rules are a small table of settings (their size is checked before it is broadcast); each page meets
all of them in one pass, and what fits is gathered in the rules' order within the page's own row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SiteRule

SCHEMA = "ord int, url string, is_regex boolean, remove array<string>, include array<string>, select string"
MOST_RULES = 100_000


def rules_table(spark: SparkSession, rules: tuple[SiteRule, ...]) -> DataFrame:
    rows = [
        (i, r.url.pattern if isinstance(r.url, re.Pattern) else r.url, isinstance(r.url, re.Pattern), list(r.remove), list(r.include), r.select)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def resolve(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, url, remove, include, select: lists of all fitting rules in order, the first selection."""
    n = rules.count()
    if n > MOST_RULES:
        raise ValueError(f"{n} site rules are more than {MOST_RULES}")
    packed = rules.agg(F.array_sort(F.collect_list(F.struct("ord", "url", "is_regex", "remove", "include", "select"))).alias("rules"))
    p = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"))
    # a single row of rules: no page is multiplied, whatever fits
    met = p.crossJoin(F.broadcast(packed))
    url = F.col("url")
    fits = F.filter("rules", lambda r: F.coalesce(F.when(r["is_regex"], F.regexp_like(url, r["url"])).otherwise(url.contains(r["url"])), F.lit(False)))
    met = met.withColumn("fit", fits)
    lists = lambda c: F.flatten(F.filter(F.transform("fit", lambda r: r[c]), lambda x: x.isNotNull()))
    chosen = F.get(F.filter(F.transform("fit", lambda r: r["select"]), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return met.select("page_id", "url", lists("remove").alias("remove"), lists("include").alias("include"), chosen.alias("select"))
