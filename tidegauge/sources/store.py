"""Stored facts: immutable datasets as partitioned Parquet, a chunked cache of fetched series, Arrow files for exchange."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The facts' columns.
KINDS = {
    "buckets": "series_id string, ts_ms long, avg double, min double, max double, count long",
    "distribution": "series_id string, ts_ms long, bucket_lo double, bucket_hi double, count double",
    "samples": "series_id string, ts_ms long, value double",
    "statistics": "series_id string, name string, value double",
}
_KEYS = {"buckets": ["series_id", "ts_ms"], "distribution": ["series_id", "ts_ms", "bucket_lo", "bucket_hi"], "samples": ["series_id", "ts_ms"], "statistics": ["series_id", "name"]}

#: Buckets of a chunk, and the age from which a bucket no longer changes.
CHUNK_BUCKETS, SETTLE_MS = 720, 300_000


class DatasetStore:
    """Facts of each kind in one table, partitioned by dataset. A dataset is written once; a second write is an error."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, dataset: str) -> str:
        if kind not in KINDS or not dataset.replace("-", "").replace("_", "").isalnum():
            raise ValueError("an unknown kind of fact, or a name of other than letters, digits, - and _")
        return f"{self.root}/{kind}/dataset_id={dataset}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def put(self, kind: str, dataset: str, rows: DataFrame) -> None:
        """Write rows, one for each key (the last by value where a key repeats), sorted so that ranges skip row groups."""
        path, keys = self._path(kind, dataset), _KEYS[kind]
        if self._exists(path):
            raise ValueError(f"dataset {dataset} has its {kind} already; facts are immutable")
        shaped = rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in KINDS[kind].split(", ")])
        rest = [c for c in shaped.columns if c not in keys]
        one = shaped.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("v")).select(*keys, "v.*")
        one.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)

    def get(self, kind: str, dataset: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows with start < ts_ms <= end, of one dataset's folder alone."""
        rows = self.spark.read.schema(KINDS[kind]).parquet(self._path(kind, dataset))
        if start is not None:
            rows = rows.filter(F.col("ts_ms") > start)
        return rows if end is None else rows.filter(F.col("ts_ms") <= end)

    def interval(self, kind: str, dataset: str) -> tuple[int | None, int | None]:
        found = self.get(kind, dataset).agg(F.min("ts_ms"), F.max("ts_ms")).first()
        return found[0], found[1]


class SeriesCache:
    """Buckets of fetched queries in chunks of CHUNK_BUCKETS steps, one folder a (query, step, chunk). A chunk that lies
    wholly before now - settle when it is fetched is final; others are fetched again once older than their time to live.
    A complete answer is never replaced by a partial one."""

    def __init__(self, spark: SparkSession, root: str, ttl_ms: int = 30_000, settle_ms: int = SETTLE_MS) -> None:
        self.spark, self.root, self.ttl_ms, self.settle_ms = spark, root.rstrip("/"), ttl_ms, settle_ms

    def chunks(self, start: int, end: int, step: int) -> list[int]:
        """Starts of the chunks that (start, end] meets."""
        size = step * CHUNK_BUCKETS
        return list(range(start // size * size, end, size))

    def _state(self, key: str) -> DataFrame:
        path = f"{self.root}/{key}/state"
        empty = "chunk long, fetched_ms long, final boolean, complete boolean, n int"
        store = DatasetStore(self.spark, self.root)
        rows = self.spark.read.schema(empty).parquet(path) if store._exists(path) else self.spark.createDataFrame([], empty)
        return rows.groupBy("chunk").agg(F.max_by(F.struct("fetched_ms", "final", "complete", "n"), F.struct("complete", "fetched_ms")).alias("s")).select("chunk", "s.*")

    def missing(self, key: str, start: int, end: int, step: int, now: int) -> list[int]:
        """Chunks that must be fetched: never fetched, partial, or neither final nor fresh."""
        known = {r["chunk"]: r for r in self._state(key).collect()}  # one row a chunk of one query
        return [c for c in self.chunks(start, end, step) if c not in known or not known[c]["complete"] or not (known[c]["final"] or now - known[c]["fetched_ms"] <= self.ttl_ms)]

    def get(self, key: str, start: int, end: int, step: int, now: int, fetch: Callable[[int, int], tuple[DataFrame, bool]]) -> DataFrame:
        """Buckets with start < ts_ms <= end. fetch(a, b) gives the rows of (a, b] and whether they are complete."""
        size = step * CHUNK_BUCKETS
        for chunk in self.missing(key, start, end, step, now):
            rows, complete = fetch(chunk, chunk + size)
            before = {r["chunk"]: r for r in self._state(key).collect()}.get(chunk)
            if before and before["complete"] and not complete:
                continue
            n = (before["n"] if before else 0) + 1
            rows.write.mode("overwrite").parquet(f"{self.root}/{key}/data/chunk={chunk}/n={n}")
            state = self.spark.createDataFrame([(chunk, now, chunk + size <= now - self.settle_ms, complete, n)], "chunk long, fetched_ms long, final boolean, complete boolean, n int")
            state.coalesce(1).write.mode("append").parquet(f"{self.root}/{key}/state")
        return self.peek(key, start, end, step)

    def peek(self, key: str, start: int, end: int, step: int) -> DataFrame:
        """What is known, without a fetch."""
        wanted = self.chunks(start, end, step)
        state = self._state(key).filter(F.col("chunk").isin(*wanted)).collect()
        paths = [f"{self.root}/{key}/data/chunk={r['chunk']}/n={r['n']}" for r in state]
        if not paths:
            return self.spark.createDataFrame([], KINDS["buckets"])
        return self.spark.read.parquet(*paths).filter((F.col("ts_ms") > start) & (F.col("ts_ms") <= end))


def write_arrow(table: pa.Table, path: str) -> None:
    """An Arrow file that is there whole or not at all: written beside and renamed."""
    with pa.OSFile(f"{path}.part", "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    os.replace(f"{path}.part", path)


def read_arrow(path: str) -> pa.Table:
    with pa.memory_map(path) as source:
        return pa.ipc.open_file(source).read_all()


def exchange(tables: dict[str, DataFrame], folder: str, meta: dict, max_rows: int = 2_000_000) -> None:
    """Hand small results over as Arrow files; the description comes last, so that its presence means all is there. More
    than max_rows in a table is an error, since toArrow brings them to the driver."""
    os.makedirs(folder, exist_ok=True)
    for name, df in tables.items():
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows")
        write_arrow(df.toArrow(), f"{folder}/{name}.arrow")
    with open(f"{folder}/meta.json.part", "w") as out:
        json.dump(meta | {"tables": sorted(tables)}, out)
    os.replace(f"{folder}/meta.json.part", f"{folder}/meta.json")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).filter("__n = 1").drop("__n")
