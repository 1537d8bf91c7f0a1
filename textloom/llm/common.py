"""Shared pieces of the training-data operators: table access, Arrow blocks, shared scratch folders."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.sources.tables import spread

#: Bytes of text that a kernel works on at once.
BLOCK_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch between Spark and Python.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder; in local mode, as in tests, a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on: whole texts in batches of the usual 10,000 rows fill the memory beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files as they end; otherwise those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, any executor can be lost."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    with without_leftovers(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give freed memory back to the system, so that a worker that lives through many stages keeps only what it uses."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a record batch with about `limit` bytes of text each (one row at least): (offset, slice)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield at, batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield at, batch.slice(at)


def map_text_blocks(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Apply kernel to blocks of about `limit` bytes of text; rows stay in their partitions."""

    small_batches(df.sparkSession)

    def run(batches):
        trim()
        for batch in batches:
            for _, block in blocks(batch, column, limit):
                yield kernel(block)
        trim()

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty) of a table, whatever else it has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
