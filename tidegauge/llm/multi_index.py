"""Inverted multi-index for nearest neighbours by inner product.

Each half of the vectors is quantised apart; a pair of centroids, one a half, is a cell. A query walks the cells in the
order of summed distance of its halves to the centroids, by a heap over the two sorted lists, until the cells visited
hold enough entries; all of these are then ranked by exact inner products in double precision. Entries and queries meet by
first centroid, each query with a mask of the second centroids it visits there. Both sides are cut into blocks, so that
a hot cell is many tasks and no task holds more than two blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidegauge.llm.common import cut_lineage, partitions, table

K = 20
#: The codebooks are fitted on about this many vectors.
TRAIN_VECTORS = 20_000
CENTROIDS = 64
ROUNDS = 15
SEED = 5
#: The share of all entries that a query's cells must hold at least, at every size of table: what vectors without any
#: structure need for a recall of 0.9; clustered ones do with a few hundredths. Beyond the share, SPARE_ENTRIES times as
#: many entries as are asked for are visited, which is what keeps the recall of tables that hold few times k vectors.
ENTRY_SHARE = 0.45
SPARE_ENTRIES = 4
#: Rows of a block of entries or queries.
BLOCK = 2_048
QUERY_EVERY = 20


@dataclass
class Codebooks:
    """Centroids of the two halves; a cell is first * len(second) + second."""

    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((p**2).sum(axis=1)[:, None] - 2 * p @ c.T + (c**2).sum(axis=1)) for p, c in ((x[:, : self.half], self.first), (x[:, self.half :], self.second)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
        """Cells by summed distance until they hold want entries; empty cells are passed over."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, held, out = [(a[order_a[0]] + b[order_b[0]], 0, 0)], 0, []
        while heap and held < want:
            _, i, j = heapq.heappop(heap)
            cell = int(order_a[i] * len(self.second) + order_b[j])
            if sizes[cell]:
                out.append(cell)
                held += int(sizes[cell])
            if j + 1 < len(order_b):
                heapq.heappush(heap, (a[order_a[i]] + b[order_b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(order_a):
                heapq.heappush(heap, (a[order_a[i + 1]] + b[order_b[0]], i + 1, 0))
        return out


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part: with an id and a vector that is not null, not all
    zero, without null or non-finite components, and of the commonest length (the longer one on a tie)."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("embedding") == (length["n"] if length else 0))


def train(rows: DataFrame, centroids: int = CENTROIDS, train_vectors: int = TRAIN_VECTORS) -> Codebooks | None:
    """Codebooks from a sample by hash of about train_vectors rows of usable(); None for an empty table."""
    n = rows.count()
    if n == 0:
        return None
    rate = min(1.0, train_vectors / n)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("multi-index")), F.lit(1_000_000)) < rate * 1_000_000)
    got = sample.orderBy("vec_id").select("embedding").toPandas()["embedding"]
    if not len(got):
        got = rows.limit(train_vectors).toPandas()["embedding"]
    x = np.stack(got.to_numpy()).astype(np.float64)
    half = max(1, x.shape[1] // 2)
    second = x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))
    return Codebooks(k_means(x[:, :half], centroids, SEED), k_means(second, centroids, SEED + 1))


def _matrix(column: pa.Array, half: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.hstack([x, np.zeros((len(x), 1))]) if x.shape[1] == half else x


def _blocks(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, centroids: int = CENTROIDS, entry_share: float = ENTRY_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, its own vec_id left out; ties to the smaller
    vec_id; rows that share a vec_id are candidates each, in no order among themselves where their scores tie. queries: rows of vectors, the smallest vector counting where a vec_id repeats. Every vector is indexed.
    A query that takes no part has no rows."""
    rows = usable(vectors)
    books = train(rows, centroids)
    out_schema = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return vectors.sparkSession.createDataFrame([], out_schema)

    n_second = len(books.second)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second = np.divmod(books.cells(_matrix(batch.column("embedding"), books.half)), n_second)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))], names=["vec_id", "embedding", "first", "second"])

    entries = cut_lineage(rows.mapInArrow(place, "vec_id long, embedding array<double>, first int, second int"))
    # At most centroids ** 2 rows, whatever the table's size.
    sizes = np.zeros((len(books.first), n_second), dtype=np.int64)
    for r in entries.groupBy("first", "second").count().collect():
        sizes[r["first"], r["second"]] = r["count"]
    want = int(entry_share * sizes.sum()) + SPARE_ENTRIES * k + 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, first, masks = [], [], []
            for i, (a, b) in enumerate(zip(*books.distances(_matrix(batch.column("embedding"), books.half)), strict=True)):
                seen = np.zeros(sizes.shape, dtype=np.uint8)
                seen.reshape(-1)[books.walk(a, b, sizes.reshape(-1), want)] = 1
                visited = np.flatnonzero(seen.any(axis=1))
                owner += [i] * len(visited)
                first += visited.tolist()
                masks += [seen[f].tobytes() for f in visited]
            row = pa.array(owner, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(row), batch.column("embedding").take(row), pa.array(first, type=pa.int32()), pa.array(masks, type=pa.binary())], names=["query_id", "query", "first", "mask"])

    # A walk is slow beside the size of its query, so queries are dealt to all tasks and not gathered by their bytes.
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).repartition(partitions(rows.sparkSession), "vec_id")
    visits = cut_lineage(asked.mapInArrow(walk, "query_id long, query array<double>, first int, mask binary"))
    loads = visits.groupBy("first").agg(F.count("*").alias("n_queries"))
    shape = entries.groupBy("first").agg(F.count("*").alias("n_entries")).join(loads, "first").select("first", _blocks(F.col("n_entries")).alias("e_blocks"), _blocks(F.col("n_queries")).alias("q_blocks"))
    shape = cut_lineage(shape)  # a row for each centroid of the first half: bounded, so it may be broadcast
    own_block = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    dealt_entries = entries.join(F.broadcast(shape), "first").select("vec_id", "embedding", "second", "first", own_block("vec_id", F.col("e_blocks")).alias("e"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"))
    dealt_queries = visits.join(F.broadcast(shape), "first").select("query_id", "query", "mask", "first", F.explode(F.sequence(F.lit(0), F.col("e_blocks") - 1)).alias("e"), own_block("query_id", F.col("q_blocks")).alias("q"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k)

    keys = ["first", "e", "q"]
    partial = dealt_entries.groupBy(*keys).cogroup(dealt_queries.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(entries: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best visited entries of each query within two blocks. The entries of a second centroid meet the queries that
    visit it in one matrix product and no others. Its scores choose; those within reach of the k-th are then summed in
    a fixed order, so that equal vectors tie exactly."""
    if entries.empty or queries.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    entries = entries.sort_values(["second", "vec_id"])
    ids, x = entries["vec_id"].to_numpy(), np.stack(entries["embedding"].to_numpy()).astype(np.float64)
    cells, first = np.unique(entries["second"].to_numpy(), return_index=True)
    bounds = np.append(first, len(ids)).tolist()
    asked, q = queries["query_id"].to_numpy(), np.stack(queries["query"].to_numpy()).astype(np.float64)
    visits = np.stack([np.frombuffer(m, dtype=np.uint8) for m in queries["mask"]])[:, cells]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(asked), 256):
        part = slice(at, at + 256)
        near = np.full((len(asked[part]), len(ids)), -np.inf)
        for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            rows = np.flatnonzero(visits[part, c])
            if len(rows):
                near[rows, a:b] = q[part][rows] @ x[a:b].T
        near[asked[part][:, None] == ids] = -np.inf
        n = min(k, len(ids))
        reach = 1e-9 * np.abs(np.where(np.isfinite(near), near, 0)).max(axis=1)
        edge = np.partition(near, len(ids) - n, axis=1)[:, len(ids) - n] - reach
        for row, (scores, least) in enumerate(zip(near, edge, strict=True), at):
            own = np.flatnonzero((scores >= least) & np.isfinite(scores))
            score = (x[own] * q[row]).sum(axis=1)
            best = np.lexsort((ids[own], -score))[:k]
            out.append((np.full(len(best), asked[row]), ids[own][best], score[best]))
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0)).select("query_id", "rank", "vec_id", "score")


#: The index is approximate; its recall is measured against brute force.
ORACLE = None
