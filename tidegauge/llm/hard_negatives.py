"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells whose edges hold every component of the table; a vector's approximation is its cells, a
byte a dimension. For an anchor, a table of its component times the edges of each cell gives, cell by cell, the least and
the greatest that a dimension can add; summed over a vector's cells they bound its score from both sides. Only candidates
whose bounds leave them a place are scored exactly: among the rows of the anchor's label those that can reach the
first few, among the others those that can lie in a positive's window and before what surely lies there.

Rows and anchors meet in blocks: each block of rows with each block of anchors, once for rows of the anchor's label and
once for the others, so a hot label is many tasks, and no task holds more than two blocks. Nothing is left out: the
bounds hold for every row, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import stored, table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
ANCHOR_EVERY = 50
#: Cells of a dimension, numbered by a byte; the middle ones are even over SPREAD deviations to both sides of the mean.
CELLS = 256
SPREAD = 4
#: Rows of a block of rows or anchors. Labels are dealt to so many groups, whose blocks are apart.
BLOCK = 4_096
LABEL_GROUPS = 16
#: Anchors whose bounds are held at once.
ANCHORS_AT_ONCE = 16
#: Components beyond this are refused: the integer would not be that of the contract any more.
MAX_COMPONENT = 1 << 52


def cells_of(low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """First value of each cell of each dimension (dims x cells), and one past the last value of all: integers, rising.
    Cells that would be narrower than 1 are empty."""
    a = np.clip(np.floor(mean - SPREAD * deviation), low, high).astype(np.int64)
    b = np.clip(np.ceil(mean + SPREAD * deviation), low, high).astype(np.int64)
    width = np.maximum(1, -((a - b - 1) // (cells - 2)))
    inner = a[:, None] + width[:, None] * np.arange(cells - 1)
    edges = np.concatenate([low[:, None], np.minimum(inner, high[:, None] + 1), high[:, None] + 1], axis=1)
    return np.maximum.accumulate(edges, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x array<long>) of the rows that take part: with an id, a label and a vector that is neither null nor
    empty and holds only finite components; where a vec_id repeats, the row with the smallest label and vector."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite)
    whole = F.transform(v, lambda x: F.when(F.abs(x * 256) <= MAX_COMPONENT, F.floor(x * 256)).otherwise(F.raise_error("a component is beyond 2^44").cast("long")))
    return rows.select("vec_id", "label", whole.alias("x")).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")


def _edges(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Cell edges for each length of vector: from the least, greatest, mean and deviation of every dimension over all rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for x in _by_length(batch.column("x")).values():
                x = x[1]
                now = [x.min(axis=0), x.max(axis=0), x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0), np.full(x.shape[1], len(x))]
                old = held.get(x.shape[1])
                held[x.shape[1]] = now if old is None else [np.minimum(old[0], now[0]), np.maximum(old[1], now[1]), *(a + b for a, b in zip(old[2:], now[2:], strict=True))]
        for dims, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), *(pa.array(f, k) for f, k in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=["dims", "dim", "low", "high", "s", "ss", "n"])

    parts = rows.select("x").mapInArrow(sums, "dims int, dim int, low long, high long, s double, ss double, n long")
    # A row a dimension and length, whatever the table's size.
    found = parts.groupBy("dims", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n")).orderBy("dims", "dim").toPandas()
    out = {}
    for dims, f in found.groupby("dims"):
        mean = (f["s"] / f["n"]).to_numpy()
        out[int(dims)] = cells_of(f["low"].to_numpy(), f["high"].to_numpy(), mean, np.sqrt(np.maximum(0, (f["ss"] / f["n"]).to_numpy() - mean**2)), cells)
    return out


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, begins = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    out = {}
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        out[n] = (own, flat[begins[own][:, None] + np.arange(n)])
    return out


def approximate(rows: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """The file: rows with the cells of their vector, a byte a dimension."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[bytes] = [b""] * batch.num_rows
            for n, (own, x) in _by_length(batch.column("x")).items():
                code = np.stack([np.searchsorted(edges[n][d, 1:-1], x[:, d], side="right") for d in range(n)], axis=1).astype(np.uint8)
                for i, c in zip(own.tolist(), code, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(place, "vec_id long, label long, x array<long>, cells binary")


def _scores(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products: in 64 bits where nothing can overflow, else in Python's integers, which must then fit."""
    if len(x) == 0:
        return np.zeros(0, dtype=np.int64)
    if int(np.abs(x).max()) * int(np.abs(anchor).max()) * x.shape[1] < 1 << 62:
        return x @ anchor
    return np.array((x.astype(object) @ anchor.astype(object)).tolist(), dtype=np.int64)


class Bounds:
    """Least and greatest scores of a block's rows for some anchors, by table lookup."""

    def __init__(self, cells: np.ndarray, edges: np.ndarray, anchors: np.ndarray) -> None:
        first, last = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        limit = max(int(np.abs(edges).max()), 1) * max(int(np.abs(anchors).max()), 1) * edges.shape[0]
        if limit >= 1 << 62:
            self.low = np.full((len(anchors), len(cells)), np.iinfo(np.int64).min)
            self.high = np.full((len(anchors), len(cells)), np.iinfo(np.int64).max)
            return
        self.low = np.zeros((len(anchors), len(cells)), dtype=np.int64)
        self.high = np.zeros_like(self.low)
        for d in range(edges.shape[0]):
            a, b = anchors[:, d, None] * first[d], anchors[:, d, None] * last[d]
            self.low += np.minimum(a, b).take(cells[:, d], axis=1)
            self.high += np.maximum(a, b).take(cells[:, d], axis=1)


def _matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return _by_length(rows["x"].combine_chunks()) if rows.num_rows else {}


def _cells(rows: pa.Table, own: np.ndarray, n: int) -> np.ndarray:
    column = rows["cells"].combine_chunks().take(pa.array(own))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(own), n)


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest value; None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _positives(edges: dict[int, np.ndarray], k: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first k rows of each anchor's own label within two blocks."""
    out: list[tuple[int, int, int]] = []
    mine, asked = _matrices(rows), _matrices(anchors)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    anchor_ids, anchor_labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
    for n, (a_own, q) in asked.items():
        if n not in mine:
            continue
        r_own, x = mine[n]
        cells = _cells(rows, r_own, n)
        for label in np.unique(anchor_labels[a_own]).tolist():
            of_label = np.flatnonzero(labels[r_own] == label)
            those = np.flatnonzero(anchor_labels[a_own] == label)
            for at in range(0, len(those) if len(of_label) else 0, ANCHORS_AT_ONCE):
                some = those[at : at + ANCHORS_AT_ONCE]
                bounds = Bounds(cells[of_label], edges[n], q[some])
                for i, low, high in zip(some.tolist(), bounds.low, bounds.high, strict=True):
                    others = np.flatnonzero(ids[r_own[of_label]] != anchor_ids[a_own[i]])
                    least = _kth(low[others], k)
                    near = of_label[others if least is None else others[high[others] >= least]]
                    score = _scores(x[near], q[i])
                    best = np.lexsort((ids[r_own[near]], -score))[:k]
                    out += [(int(anchor_ids[a_own[i]]), int(ids[r_own[near[b]]]), int(score[b])) for b in best]
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor_id", "positive_id", "positive_score"), columns, strict=True)})


def _negatives(edges: dict[int, np.ndarray], k: int, window: tuple[int, int], rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first k rows of other labels in each positive's window within two blocks."""
    out: list[tuple[int, int, int, int, int]] = []
    mine, asked = _matrices(rows), _matrices(anchors)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    anchor_ids, anchor_labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
    positives = anchors["positives"].to_pylist()
    for n, (a_own, q) in asked.items():
        if n not in mine:
            continue
        r_own, x = mine[n]
        cells = _cells(rows, r_own, n)
        own_ids, own_labels = ids[r_own], labels[r_own]
        for at in range(0, len(a_own), ANCHORS_AT_ONCE):
            bounds = Bounds(cells, edges[n], q[at : at + ANCHORS_AT_ONCE])
            for i, low, high in zip(range(at, len(a_own)), bounds.low, bounds.high, strict=False):
                other = np.flatnonzero(own_labels != anchor_labels[a_own[i]])
                low, high = low[other], high[other]
                scored: dict[int, int] = {}
                for positive in positives[a_own[i]]:
                    # 50 ps <= 100 ns <= 95 ps, in whole numbers.
                    least, most = -(-window[0] * positive["positive_score"] // 100), window[1] * positive["positive_score"] // 100
                    can = np.flatnonzero((high >= least) & (low <= most)) if least <= most else np.zeros(0, dtype=np.int64)
                    sure = can[(low[can] >= least) & (high[can] <= most)]
                    if (beyond := _kth(low[sure], k)) is not None:
                        can = can[high[can] >= beyond]
                    new = [c for c in can.tolist() if c not in scored]
                    scored.update(zip(new, _scores(x[other[new]], q[i]).tolist(), strict=True))
                    score = np.array([scored[c] for c in can.tolist()], dtype=np.int64)
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    named = own_ids[other[can[inside]]]
                    for b in np.lexsort((named, -score[inside]))[:k]:
                        out.append((int(anchor_ids[a_own[i]]), positive["positive_id"], positive["positive_score"], int(named[b]), int(score[inside[b]])))
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), columns, strict=True)})


def _first(found: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def _group(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(LABEL_GROUPS)).cast("int")


def _in_blocks(df: DataFrame, vec_id: str, block_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """df with the number of its block within the group of its label, and the number of blocks of each group."""
    n = {r["g"]: -(-r["count"] // block_rows) for r in df.groupBy(_group(F.col("label")).alias("g")).count().collect()}  # LABEL_GROUPS rows
    counts = F.array(*[F.lit(n.get(g, 1)) for g in range(LABEL_GROUPS)])
    grouped = df.withColumn("g", _group(F.col("label")))
    return grouped.withColumn("block", F.pmod(F.xxhash64(vec_id), F.get(counts, F.col("g"))).cast("int")), n


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOW, HIGH), cells: int = CELLS, block_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows as of usable() and anchors, which
    are rows of it. Vectors of different lengths do not meet."""
    rows, _ = stored(rows, "negatives-rows")
    edges = _edges(rows, cells)
    file, _ = stored(approximate(rows, edges), "negatives-approximations")
    held, n_rows = _in_blocks(file, "vec_id", block_rows)
    asked = anchors.join(rows.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), "label", "x")
    asked, n_asked = _in_blocks(asked, "anchor_id", block_rows)
    rows_of = F.array(*[F.lit(n_rows.get(g, 0)) for g in range(LABEL_GROUPS)])
    asked_of = F.array(*[F.lit(n_asked.get(g, 0)) for g in range(LABEL_GROUPS)])

    # Same label: the blocks of rows and anchors of one group meet.
    keys = ["g", "block", "asked"]
    left = held.withColumn("asked", _every(F.get(asked_of, F.col("g")))) if n_asked else held.withColumn("asked", F.lit(0)).limit(0)
    left = left.filter(F.get(asked_of, F.col("g")) > 0)
    right = asked.withColumnRenamed("block", "asked").withColumn("block", _every(F.get(rows_of, F.col("g"))))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _positives(edges, positives, a, b), "anchor_id long, positive_id long, positive_score long")
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))  # at most positives each

    # Other labels: every block of rows meets every block of anchors; equal labels are passed over inside.
    offsets, total = np.concatenate([[0], np.cumsum([n_asked.get(g, 0) for g in range(LABEL_GROUPS)])]), sum(n_asked.values())
    first_row = np.concatenate([[0], np.cumsum([n_rows.get(g, 0) for g in range(LABEL_GROUPS)])])
    place = lambda first, block: (F.get(F.array(*[F.lit(int(v)) for v in first]), F.col("g")) + F.col(block)).cast("int")
    keys = ["block", "asked"]
    left = held.withColumn("block", place(first_row, "block")).drop("g")
    left = left.withColumn("asked", _every(F.lit(total))) if total else left.withColumn("asked", F.lit(0)).limit(0)
    right = asked.withColumn("asked", place(offsets, "block")).drop("g", "block").join(near, "anchor_id")
    right = right.withColumn("block", _every(F.lit(max(1, sum(n_rows.values())))))
    far = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _negatives(edges, negatives, window, a, b), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _first(far, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 3 hard negatives of each of the 5 first positives of every vector whose vec_id is divisible by 50.

    Rows whose id, label or vector is null, or whose vector is empty or holds a null or non-finite component, take no part.
    Of rows with one vec_id the one with the smallest label and vector counts. An anchor alone with its label has no
    positives, a positive without anything in its window no rows; a positive's score below 0 leaves its window empty.
    Components beyond 2^44 stop the query with an error, as does a score that is no long. An empty table gives no rows;
    further columns play no part."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", relabelled.alias("label"), "embedding"))
    return mine(rows, rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0))


#: DuckDB: every anchor with every row.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(CAST(c AS DOUBLE))]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {NEGATIVES}
"""
