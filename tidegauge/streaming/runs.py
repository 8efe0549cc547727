"""Running streams over what is there now: a folder that driver and executors share, and one pass that ends."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs in one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidegauge-stream-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found}/{name}-{uuid.uuid4().hex}"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State variables need the RocksDB store; streams keep the one they were started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_now(writer: DataStreamWriter, checkpoint: str) -> None:
    """All that is there, then the end; a later run goes on where this one stopped."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_parts(rows: DataFrame, path: str, parts: list[str], after_each: Callable[[], None]) -> None:
    """rows as a folder of files that grows: those of each condition in turn, and after_each behind every one of them."""
    for condition in parts:
        rows.filter(condition).write.mode("append").parquet(path)
        after_each()
