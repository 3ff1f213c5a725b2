"""What the operators share: the shared folder, Arrow views of text, and small table helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in most contracts.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch at most.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Workers beside a full heap have little memory; long texts make default batches large."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; our own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webdistill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back.  Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webdistill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hand_back() -> None:
    """Freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def tidy(run):
    """An Arrow function that hands freed memory back when its task ends; workers outlive their tasks."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


class Workspace:
    """Tables of one query in the shared folder, and the disk they and past shuffles hold."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[str, str | None]] = {}
        small_batches(spark)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As the function below; then lets Spark remove the shuffle files that led to the table."""
        path = f"{shared_dir(self.spark)}/webdistill/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, None)
        del df
        self._tidy()
        return out

    def store_sorted(self, df: DataFrame, name: str, by: tuple[str, ...]) -> DataFrame:
        """A table in buckets by hash of `by`, each one sorted file: joined on `by` with its like without an exchange."""
        own = f"webdistill_{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/webdistill/{own}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        write = df.write.format("parquet").option("compression", "snappy").option("path", path)
        write.bucketBy(buckets, *by).sortBy(*by).saveAsTable(own)
        out = self.spark.table(own)
        self._paths[id(out)] = (path, own)
        del df, write
        self._tidy()
        return out

    def unsorted(self, table: DataFrame) -> DataFrame:
        """A stored table read as plain files.  A union of bucketed scans counts as dealt by key though it isn't (seen
        in Spark 4.1.2, where a sum by key then misses rows), so buckets must not be known below a union."""
        return self.spark.read.schema(table.schema).parquet(self._paths[id(table)][0])

    def _tidy(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, table: DataFrame) -> None:
        """Remove a stored table that nothing will read again."""
        self._remove(id(table))

    def keep(self, *tables: DataFrame) -> None:
        """Remove all stored tables but these."""
        for k in [k for k in self._paths if k not in {id(t) for t in tables}]:
            self._remove(k)

    def _remove(self, k: int) -> None:
        path, own = self._paths.pop(k)
        if own:
            self.spark.sql(f"DROP TABLE IF EXISTS {own}")
        delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clean(spark: SparkSession) -> None:
    """Remove what queries left in the shared folder; their results can't be read after that."""
    delete(spark, f"{shared_dir(spark)}/webdistill")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under our own names, so that other columns can never clash."""
    small_batches(df.sparkSession)
    return df.select(*(df[c].alias(k) for k, c in columns.items()))


def views(column: pa.Array, most: int = 600_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Zero-copy slices of a string column of about `most` bytes: first row, past row, bytes, bounds.

    bounds are byte offsets of each text in the slice's bytes; null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Each text's UTF-8 bytes without decoding."""
    return column.cast(pa.binary()).to_pylist()


def text_key(column: str = "text"):
    """Tells apart rows that share a doc_id; equal rows get equal keys and so equal results."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def same(a: DataFrame, b: DataFrame, *columns: str):
    """Null-safe equality on columns."""
    on = a[columns[0]].eqNullSafe(b[columns[0]])
    for c in columns[1:]:
        on &= a[c].eqNullSafe(b[c])
    return on
