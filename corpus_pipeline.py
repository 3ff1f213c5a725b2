"""From raw documents to token ids: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but the last return the
columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdistill.llm import decontaminate, jaccard, linedup, pieces, quality
from webdistill.llm.common import store, table, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _documents(quality.quality_rules(docs, keep_text=True).filter("kept").withColumnRenamed("id", "doc_id"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document each; no document goes."""
    kept = linedup.dedup_lines(docs, carry=("lang", "source"))
    return _documents(kept.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), F.col("c0").alias("lang"), F.col("c1").alias("source")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, similarity 0.8) stays: that with the least
    doc_id.  Rows with a null or repeated doc_id are documents of their own; only rows equal in doc_id and
    text are one."""
    first = jaccard.jaccard_firsts(docs, size=5, num=4, den=5).select(F.col("id").alias("first_id"), F.col("th").alias("first_th"))
    rows = docs.select(*COLUMNS).withColumn("th", text_key())
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["first_id"]) & (rows["th"] == first["first_th"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "th"]).select(*COLUMNS)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("text", "lang", "source"))
    kept = found.filter(~F.col("contaminated"))
    return _documents(kept.select(F.col("id").alias("doc_id"), F.col("c0").alias("text"), F.col("c1").alias("lang"), F.col("c2").alias("source")))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return pieces.encode(docs, pieces.given_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", stage_quality),
    ("lines", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("encode", stage_encode),
]

#: Robust estimates and graph components are beyond SQL here; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
