"""Token-ID output: Parquet files of id lists that can be read in parts.

Each document becomes one row (doc_id, n_tokens, ids). Rows stand in ascending doc_id order; row groups and pages have
a stated size, footers hold page indexes, ids are dictionary or delta encoded. Thus a reader of a doc_id range skips
row groups and pages, and one of the counts alone never touches the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.chunks import library_encoder
from tidegauge.llm.common import WIDE_SLICE_BYTES, fresh_path, partitions, table, text_slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Text of a file, where that makes more files than spark.sql.shuffle.partitions.
FILE_TEXT_BYTES = 256 << 20

_ROWS = "doc_id long, n_tokens int, ids array<int>"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text, end_id last. A null text counts as empty, a null doc_id stays null."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_encoder(vocabulary, True)
        for whole in batches:
            for batch in text_slices(whole, "text", WIDE_SLICE_BYTES):
                ids, ends = memo.encode_batch(batch.column("text"), end_id)
                offsets = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                counts = pa.array(np.diff(offsets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, lists], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(step, _ROWS)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encode and write. Texts are dealt by doc_id range (they are smaller than their ids), so that files follow each
    other in doc_id order; equal doc_ids share a file. Writer version 2 without dictionaries packs integers as deltas in
    miniblocks of the width they need. An empty table leaves a folder with a schema and no rows."""
    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = dealt.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = dealt.repartitionByRange(max(partitions(spark), -(-size // FILE_TEXT_BYTES)), "doc_id").sortWithinPartitions("doc_id")
    (
        encode(dealt, vocabulary, end_id)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, with_ids: bool = True) -> DataFrame:
    """Rows of the doc_id range first..last (both included, open if None); without ids, only the small columns are read."""
    rows = spark.read.schema(_ROWS).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows if with_ids else rows.select("doc_id", "n_tokens")


def part_number(file: str) -> Column:
    return F.regexp_extract(file, "^part-([0-9]+)", 1).cast("long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row in the files, computed from the ids as read. start counts the ids
    of the rows before it in the files, which is also the order of rows with one doc_id; null doc_ids come first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("place"), batch.column("doc_id"), pa.array(counts), pa.array(sums, type=pa.int64())], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = read(spark, path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"), "doc_id", "ids")
    small = rows.mapInArrow(step, "file string, place long, doc_id long, n_tokens long, ids_crc32 long")
    # Files are named by partition number, which follows doc_id order; names of more than 99,999 files do not.
    in_file = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    files = read(spark, path, with_ids=False).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum(F.col("n_tokens").cast("long")).alias("tokens"))
    before = files.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy(part_number("file")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "before")
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))
    return small.join(before, "file").select("doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents, read the files back and digest them."""
    path = fresh_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
