"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one Python step works on at a time. Steps that hold many numbers a byte take the first, lookups that
#: cost something a call the second. A longer single text comes alone; each operator then takes it in parts.
SLICE_BYTES = 1 << 20
WIDE_SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs in one
    process, a temporary one. Elsewhere an unset folder is an error, since executors could not read the driver's."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit

        found = tempfile.mkdtemp(prefix="tidegauge-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its files go when this Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    import atexit

    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone already
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; readable after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path. Unlike a checkpoint's, its size estimate
    is that of its files, so that in a loop the estimates do not multiply from turn to turn."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was stored, once nothing reads it any more."""
    _remove(spark, path)


def fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as keep it apart from columns (case is ignored)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about size bytes of text each."""
    col = batch.column(column)
    if len(col) == 0:
        return
    wide = col.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    start = 0
    while start < len(col):
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(len(col), max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end
    give_back()


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system, since Python workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] for each (s, n)."""
    lengths = lengths.astype(np.int64, copy=False)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)]
