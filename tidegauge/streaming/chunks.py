"""Answers of a source, chunk by chunk, as they come again: a late or repeated answer replaces an earlier one, but a partial
answer never replaces a complete one.

Every answer is kept under its batch, so a batch that is run again overwrites its own files alone; which answer of a chunk
counts is found on read, by one aggregation of the answers (not of their rows) and a semi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def keep(stream: DataFrame, path: str) -> DataStreamWriter:
    """Writer of a stream of answer rows (chunk keys, fetched_at, complete, ...) below path, one folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def winners(rows: DataFrame, chunk: list[str]) -> DataFrame:
    """(chunk, fetched_at, complete, asked_at): the answer that counts, the latest complete one or else the latest, and when
    the chunk was last asked for."""
    each = rows.select(*chunk, "fetched_at", "complete").distinct()
    best = each.groupBy(*chunk).agg(F.max(F.struct("complete", "fetched_at")).alias("best"), F.max("fetched_at").alias("asked_at"))
    return best.select(*chunk, "best.fetched_at", "best.complete", "asked_at")


def current(rows: DataFrame, chunk: list[str]) -> DataFrame:
    """The rows of the answers that count, each once however often an answer came."""
    return rows.join(winners(rows, chunk), [*chunk, "fetched_at", "complete"], "left_semi").distinct()


def unknown_after(rows: DataFrame, chunk: list[str], settle_ms: int) -> DataFrame:
    """(chunk, a): from when on a chunk is unknown, where a later partial answer did not replace the complete one: what the
    complete one could not have seen settled yet."""
    found = winners(rows, chunk)
    return found.filter(F.col("complete") & (F.col("asked_at") > F.col("fetched_at"))).select(*chunk, (F.col("fetched_at") - settle_ms).alias("a"))
