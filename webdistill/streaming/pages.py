"""The same operators on streams of pages: row-local and stateless, so append mode and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Options
from ..operators.pages import html_to_markdown
from ..sources.pages import PAGES


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def distill_stream(pages: DataFrame, options: Options | None = None, **where) -> DataFrame:
    return html_to_markdown(pages, options, **where)


def write_stream(distilled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, exactly once, as Parquet."""
    return distilled.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
