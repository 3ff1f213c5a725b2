"""Where pages come from and results go: crawled tables, files, standard input, and HTTP by an injected function."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"
Fetch = Callable[[str, dict[str, str]], tuple[int, str]]
AGENT = "webdistill/0.1"


class FetchError(RuntimeError):
    pass


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A crawled table (page_id, url, html) in Parquet."""
    return spark.read.parquet(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as pages; the id is a hash of the path."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("url"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))


def from_strings(spark: SparkSession, htmls: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i, None, h) for i, h in enumerate(htmls)], PAGES)


def from_stdin(spark: SparkSession) -> DataFrame:
    return from_strings(spark, [sys.stdin.buffer.read().decode("utf-8", "replace")])


def urllib_fetch(url: str, headers: dict[str, str]) -> tuple[int, str]:
    """Status and body by the standard library."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch_one(url: str, fetch: Fetch = urllib_fetch) -> str:
    """The body of a URL; a status other than 2xx raises."""
    status, body = fetch(url, {"User-Agent": AGENT})
    if not 200 <= status < 300:
        raise FetchError(f"Failed to fetch {url}: {status}")
    return body


def fetch_robots(origin: str, fetch: Fetch = urllib_fetch) -> str:
    """A site's robots.txt; whatever goes wrong, nothing is forbidden."""
    try:
        return fetch_one(origin.removesuffix("/") + "/robots.txt", fetch)
    except Exception:
        return ""


def fetch_pages(urls: DataFrame, fetch: Fetch = urllib_fetch, *, url_column: str = "url") -> DataFrame:
    """urls to page_id, url, html, error, fetched where the partitions are.  A failed page is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, error = [], []
            for url in batch.column("url").to_pylist():
                try:
                    html.append(fetch_one(url, fetch))
                    error.append(None)
                except Exception as e:
                    html.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(html, pa.string()), pa.array(error, pa.string())], names=["page_id", "url", "html", "error"])

    read = urls.select(F.xxhash64(url_column).alias("page_id"), F.col(url_column).alias("url"))
    return read.mapInArrow(run, PAGES + ", error string")


def write_markdown(distilled: DataFrame, path: str) -> None:
    """page_id and markdown as Parquet."""
    distilled.select("page_id", "markdown").write.mode("overwrite").parquet(path)
