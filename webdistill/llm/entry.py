"""The thin opN_* queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmlmain, jaccard, linedup, passages, pieces, quality, secrets, substrings, urls
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated"
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "literal")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.dedup_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.given_vocabulary(), with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "round_trip")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_htmlmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlmain.extract_main(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substrings": op2_substrings,
    "op3_jaccard": op3_jaccard,
    "op4_secrets": op4_secrets,
    "op5_urls": op5_urls,
    "op6_passages": op6_passages,
    "op7_linedup": op7_linedup,
    "op8_pieces": op8_pieces,
    "op9_quality": op9_quality,
    "op10_htmlmain": op10_htmlmain,
}
