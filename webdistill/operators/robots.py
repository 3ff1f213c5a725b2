"""robots.txt as tables: bodies to rules, and access decided for many URLs at once.

Rules are parsed once a site; pages meet only the rules of their origin, by an equality join, and the
longest fitting pattern is a max over a small struct.  A site's hot origin is no trouble: its rules are
few, so that side of the join is small, and Spark splits the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native as N

AGENT = "webdistill/0.1"


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots(origin, body) to origin, group_no, agents, ord, type, path, natively.

    Lines are numbered; a group starts at an agent line that follows a rule (or nothing), so groups are
    a running count over a body's lines.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", "\n", -1)).alias("ord", "raw"))
    clean = N.js_trim(F.regexp_replace("raw", r"#[^\n\r\x{2028}\x{2029}]*\z", ""))
    lines = lines.withColumn("line", clean).filter(F.col("line").contains(":"))
    at = F.locate(":", F.col("line"))
    lines = lines.select(
        "origin", "ord", F.lower(N.js_trim(F.substring("line", F.lit(1), at - 1))).alias("field"),
        N.js_trim(F.substring("line", at + 1, F.char_length("line"))).alias("value"),
    )
    agent = F.col("field") == "user-agent"
    rule = F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    lines = lines.filter(agent | F.col("field").isin("allow", "disallow"))
    w = Window.partitionBy("origin").orderBy("ord")
    # rules before any agent belong to a group for all
    before = F.last(F.when(agent, F.lit("agent")).when(rule, F.lit("rule")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = agent & (F.coalesce(before, F.lit("rule")) == "rule")
    seen = F.max(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = starts & ~(before.isNull() & seen.isNotNull())
    lines = lines.withColumn("is_agent", agent).withColumn("is_rule", rule).withColumn("opens", F.when(opens | seen.isNull(), 1).otherwise(0))
    lines = lines.withColumn("group_no", F.sum("opens").over(w))
    first = F.min(F.struct("ord", "is_agent")).over(Window.partitionBy("origin", "group_no"))["is_agent"]
    named = F.collect_list(F.when(F.col("is_agent"), F.lower("value"))).over(Window.partitionBy("origin", "group_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    agents = F.when(first, named).otherwise(F.concat(F.array(F.lit("*")), named))
    out = lines.withColumn("agents", agents)
    return out.select(
        "origin", "group_no", "agents", "ord", F.when(F.col("is_rule"), F.col("field")).alias("type"), F.when(F.col("is_rule"), F.col("value")).alias("path")
    )


def rules_for(rules: DataFrame, agent: str = AGENT) -> DataFrame:
    """The rules of the one group of each origin that binds the agent: origin, type, path.

    The first group that names it (either name within the other), else the last group for all.
    """
    name = agent.lower()
    specific = F.exists("agents", lambda a: (a != "*") & (F.lit(name).contains(a) | a.contains(name)))
    groups = rules.select("origin", "group_no", specific.alias("own"), F.array_contains("agents", "*").alias("all")).distinct()
    best = groups.groupBy("origin").agg(F.min(F.when(F.col("own"), F.col("group_no"))).alias("first"), F.max(F.when(F.col("all"), F.col("group_no"))).alias("last"))
    best = best.select("origin", F.coalesce("first", "last").alias("group_no"))
    return rules.join(best, ["origin", "group_no"]).filter(F.col("path").isNotNull()).select("origin", "type", "path")


def decide(pages: DataFrame, robots: DataFrame, *, agent: str = AGENT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, url, allowed.  An origin without robots.txt, or a path that no rule fits, is free."""
    p = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"))
    p = p.withColumn("origin", N.url_origin("url")).withColumn("path", N.url_path("url"))
    r = rules_for(robots_rules(robots), agent)
    # a path without a wildcard is a prefix: no pattern is compiled for it
    pattern = F.when(F.col("path").rlike(r"[*$]"), N.robots_regex("path")).alias("pattern")
    r = r.select(F.col("origin").alias("r_origin"), "type", F.col("path").alias("prefix"), pattern, N.robots_specificity("path").alias("weight"))
    # one row of rules for each origin: the pages are neither multiplied nor gathered
    r = r.groupBy("r_origin").agg(F.collect_list(F.struct("weight", (F.col("type") == "allow").alias("allow"), "prefix", "pattern")).alias("rules"))
    joined = p.join(r, p["origin"] == r["r_origin"], "left")
    fitting = F.filter("rules", lambda x: F.when(x["pattern"].isNull(), F.col("path").startswith(x["prefix"])).otherwise(F.regexp_like(F.col("path"), x["pattern"])))
    best = F.array_max(F.transform(fitting, lambda x: F.struct(x["weight"].alias("weight"), x["allow"].alias("allow"))))
    return joined.select("page_id", "url", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def gate(pages: DataFrame, robots: DataFrame, *, force: bool = False, agent: str = AGENT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Pages that may be read; with force all, and robots_blocked says which may not."""
    verdict = decide(pages, robots, agent=agent, id_column=id_column, url_column=url_column).select(F.col("page_id").alias("v_id"), "allowed")
    out = pages.join(verdict.dropDuplicates(["v_id"]), pages[id_column] == F.col("v_id"), "left").drop("v_id")
    out = out.withColumn("robots_blocked", ~F.coalesce("allowed", F.lit(True))).drop("allowed")
    return out if force else out.filter(~F.col("robots_blocked"))
