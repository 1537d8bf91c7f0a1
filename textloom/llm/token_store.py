"""Token ids as ORC files in ascending document order.

Documents are range-partitioned and sorted by id, encoded in blocks, and
written as ORC: integer run-length encoded id streams, stripes and row indexes
for stripe-parallel reads, and a Bloom filter on doc_id for metadata pruning.
File k of the folder holds the k-th range, so the place of a document among
all ids is the total of the files before it plus the ids before it in its file.

Null texts count as empty and hold the end id only. Rows with a null id come
first; repeated ids stay together, ordered by text. Empty tables give an
empty folder and empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.llm import bpe_kernel
from textloom.llm.common import id_and_text, map_text_blocks, scratch, without_leftovers

END_ID = 2
#: Bytes of text whose ids go into one file, about, where the shuffle partitions would hold more.
FILE_BYTES = 256 << 20
SCHEMA = "doc_id long, ids array<int>"


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of every row, each document closed by end_id, to ORC files at path."""

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = bpe_kernel.json_encoder(vocabulary).encode(block.column("text").to_pylist())
        counts = counts + 1
        ends = np.cumsum(counts)
        out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = ids
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))
        return pa.RecordBatch.from_arrays([block.column("doc_id"), lists], ["doc_id", "ids"])

    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    stored = map_text_blocks(ordered, kernel, SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000")
    with without_leftovers(spark):
        stored.option("orc.stripe.size", str(16 << 20)).option("compression", "lz4").orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document; a filter on doc_id is pushed to stripe statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def describe_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            n = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            crc = [zlib.crc32(view[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file")
    stored = read_tokens(spark, path)
    row = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = stored.select("doc_id", "ids", file, row.alias("row")).mapInArrow(run, "doc_id long, file int, row struct<block: long, row: long>, n_tokens long, ids_crc32 long")
    # one row per file: running totals need no window over all documents
    totals = stored.select(file, F.size("ids").cast("long").alias("n")).groupBy("file").agg(F.sum("n").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "row"))
    return (
        rows.join(F.broadcast(before), "file")  # one row per written file
        .select("doc_id", (F.col("before") + inside - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_store(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids to a new folder in the shared scratch space and describe them from the files."""
    spark = docs.sparkSession
    return describe_tokens(spark, write_tokens(docs, vocabulary, scratch(spark, "tokens"), end_id))
