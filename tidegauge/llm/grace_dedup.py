"""Exact deduplication by Grace hashing: records go to spill files by the bits of their hash, again and again where a
bucket is still too large, until each bucket fits an open-addressing table that compares complete contents.

Level 0 reads every row once, in slices: copies within a slice are told by such a table, one record a distinct content
stays (with the slice's number of copies and the row that would stay), and the rows remember their record. From then on
only records move. At each level the bytes of all buckets are summed by hash prefix; buckets that fit go to tables,
the others are spilled again by further bits. Bits cannot part copies of one content, however many there are; so the
records of a bucket that is spilled again are also dealt to parts by row, and each part passes a table of its own, which
leaves one record a content and part. A hot content thereby shrinks by the factor of a part's copies at each level, in as
many tasks as it has parts. Rows find their group over their record, of which no slice has more rows than SLICE_ROWS, so
no join has a hot key. Every level lies in the shared folder, so lost executors cost no level twice.

Equal hashes decide nothing: contents with one hash stay apart, since tables compare bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import fresh_names, fresh_path, give_back, partitions, table

#: A bucket fits a table up to so many bytes of content, counting RECORD_BYTES more for each record.
BUCKET_BYTES = 16 << 20
RECORD_BYTES = 64
#: Buckets of no more records than this are not split any further, whatever the size of their contents.
FEW_RECORDS = 4
#: Bits a level adds, and bits there are.
LEVEL_BITS, HASH_BITS = 8, 64
#: Contents and rows of a slice of level 0.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 16
#: Bytes of content a shuffle partition, where that makes more than spark.sql.shuffle.partitions.
PARTITION_BYTES = 256 << 20


class ContentTable:
    """Open addressing with linear probing. An entry is a whole content; equal hashes are settled by its bytes."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.n_bytes = 0
        self._slots = [-1] * 64

    def _home(self, h: int) -> int:
        return (h ^ (h >> 32)) & (len(self._slots) - 1)

    def _grow(self) -> None:
        self._slots = [-1] * (2 * len(self._slots))
        last = len(self._slots) - 1
        for entry, h in enumerate(self.hashes):
            at = self._home(h)
            while self._slots[at] >= 0:
                at = (at + 1) & last
            self._slots[at] = entry

    def place(self, h: int, content: bytes) -> int:
        """The entry of a content; a new one, the next number, if there is none."""
        last = len(self._slots) - 1
        at = self._home(h)
        while (entry := self._slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & last
        entry = len(self.hashes)
        self._slots[at] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.n_bytes += len(content) + RECORD_BYTES
        if 2 * len(self.hashes) > len(self._slots):
            self._grow()
        return entry


class Groups:
    """Rows or records of a slice, part or bucket by entry: number of rows, and the row that stays, which is the one with
    the largest id (null is the smallest), the smaller row number first where an id repeats."""

    def __init__(self) -> None:
        self.table = ContentTable()
        self.first: list[int] = []
        self.size: list[int] = []
        self.top: list[tuple[bool, int, int]] = []

    def add(self, h: int, content: bytes, node: int, n: int, doc: int | None, row: int) -> int:
        entry = self.table.place(h, content)
        top = (doc is not None, doc or 0, -row)
        if entry == len(self.first):
            self.first.append(node)
            self.size.append(n)
            self.top.append(top)
        else:
            self.size[entry] += n
            self.top[entry] = max(self.top[entry], top)
        return entry

    def top_doc(self, entry: int) -> int | None:
        known, doc, _ = self.top[entry]
        return doc if known else None

    def top_row(self, entry: int) -> int:
        return -self.top[entry][2]


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(name).to_pylist()


def _leaders(entries: list[int], leads: list[bool], held: Groups) -> list[pa.Array]:
    """Content, size, top id and top row of records that lead; null for the others."""
    of = lambda value, kind: pa.array([value(e) if lead else None for e, lead in zip(entries, leads, strict=True)], type=kind)
    return [of(held.table.contents.__getitem__, pa.binary()), of(held.size.__getitem__, pa.int64()), of(held.top_doc, pa.int64()), of(held.top_row, pa.int64())]


def _slices(batches: Iterator[pa.RecordBatch], content: str, h: str, doc: str, names: list[str], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Level 0: rows with their row number and record; the first row of a content in a slice is its record."""
    row = TaskContext.get().partitionId() << 40
    held, waiting = Groups(), []

    def flush() -> Iterator[pa.RecordBatch]:
        for batch, rows, entries in waiting:
            at = batch.schema.get_field_index(content)
            nodes = [held.first[e] for e in entries]
            lead = _leaders(entries, [n == r for n, r in zip(nodes, rows, strict=True)], held)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, type=pa.int64()), pa.array(nodes, type=pa.int64()), *lead], names=names)

    n_bytes = n_rows = 0
    for batch in batches:
        # Parts of a batch, so that a slice ends where it is full.
        lengths = pc.binary_length(batch.column(content)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths + RECORD_BYTES) // slice_bytes
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            piece = batch.slice(a, b - a)
            rows = range(row, row + piece.num_rows)
            entries = [held.add(hash_, c, r, 1, d, r) for hash_, c, d, r in zip(_column(piece, h), _column(piece, content), _column(piece, doc), rows, strict=True)]
            waiting.append((piece, list(rows), entries))
            row += piece.num_rows
            n_bytes += int(lengths[a:b].sum()) + RECORD_BYTES * piece.num_rows
            n_rows += piece.num_rows
            if n_bytes >= slice_bytes or n_rows >= SLICE_ROWS:
                yield from flush()
                held, waiting, n_bytes, n_rows = Groups(), [], 0, 0
    yield from flush()
    give_back()


_RECORD = "node long, h long, content binary, n long, top_doc long, top_row long"


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal keys, each as the pieces of batches that it covers."""
    run, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if key != now and run:
                yield run
                run = []
            now = key
            run.append(batch.slice(a, b - a))
    if run:
        yield run


def _enter(held: Groups, piece: pa.RecordBatch) -> list[int]:
    return [held.add(*r) for r in zip(*(_column(piece, k) for k in ("h", "content", "node", "n", "top_doc", "top_row")), strict=True)]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each part: one a content leads, the others point to it."""
    for run in _by_key(batches, ["bucket", "part"]):
        held = Groups()
        entered = [(piece, _enter(held, piece)) for piece in run]
        for piece, entries in entered:
            nodes = _column(piece, "node")
            roots = [held.first[e] for e in entries]
            lead = _leaders(entries, [a == b for a, b in zip(nodes, roots, strict=True)], held)
            yield pa.RecordBatch.from_arrays([pa.array(roots, type=pa.int64()), piece.column("node"), piece.column("h"), *lead], names=["root", "node", "h", "content", "n", "top_doc", "top_row"])
    give_back()


_GROUP = "node long, keep_id long, keep_row long, group_size long, sha256 string"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group of each record of each bucket."""
    for run in _by_key(batches, ["bucket"]):
        held = Groups()
        entered = [(piece, _enter(held, piece)) for piece in run]
        digests = [hashlib.sha256(c).hexdigest() for c in held.table.contents]
        for piece, entries in entered:
            arrays = [
                piece.column("node"),
                pa.array([held.top_doc(e) for e in entries], type=pa.int64()),
                pa.array([held.top_row(e) for e in entries], type=pa.int64()),
                pa.array([held.size[e] for e in entries], type=pa.int64()),
                pa.array([digests[e] for e in entries], type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "keep_id", "keep_row", "group_size", "sha256"])
    give_back()


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _spill(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(records: DataFrame, n_bytes: int, keys: list[str]) -> DataFrame:
    parts = max(partitions(records.sparkSession), math.ceil(n_bytes / PARTITION_BYTES))
    return records.repartition(parts, *keys).sortWithinPartitions(*keys)


def _groups_of_records(records: DataFrame, bucket_bytes: int) -> DataFrame:
    """(node, keep_id, keep_row, group_size, sha256) of each record of level 0."""
    cost = (F.octet_length("content") + RECORD_BYTES).cast("long")
    found: DataFrame | None = None
    links: list[DataFrame] = []
    results: list[tuple[int, DataFrame]] = []
    total, n_records = records.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count("*")).first()
    bits, stuck = min(HASH_BITS, math.ceil(math.log2(max(1, total / bucket_bytes))) + 1), False
    while True:
        bucket = _prefix(F.col("h"), bits)
        sums = records.groupBy(bucket.alias("bucket")).agg(F.sum(cost).alias("bytes"), F.count("*").alias("records"))
        over = _spill(sums.filter((F.col("bytes") > bucket_bytes) & (F.col("records") > FEW_RECORDS) & F.lit(not stuck)), "grace-over")
        placed = records.withColumn("bucket", bucket)
        any_over = not over.isEmpty()
        fits = placed.join(over, "bucket", "left_anti") if any_over else placed
        settled = _dealt(fits, total, ["bucket"]).mapInArrow(_settle, _GROUP)
        results.append((len(links), settled))
        if not any_over:
            break
        # Further bits, and parts by row: at least FEW_RECORDS records and about bucket_bytes of them a part.
        deeper = min(HASH_BITS, bits + LEVEL_BITS)
        n_parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") / bucket_bytes), F.floor(F.col("records") / FEW_RECORDS)))
        rest = placed.join(over.select("bucket", n_parts.alias("n_parts")), "bucket")
        rest = rest.withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_parts"))).withColumn("bucket", _prefix(F.col("h"), deeper)).drop("n_parts")
        level = _spill(_dealt(rest, total, ["bucket", "part"]).mapInArrow(_shrink, f"root long, {_RECORD}"), f"grace-level{len(links) + 1}")
        links.append(level.select("node", "root"))
        records = level.filter(F.col("content").isNotNull()).drop("root")
        left_bytes, left = records.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count("*")).first()
        # With all bits used, only copies can still go; where none went, what is left are unlike contents with one hash.
        stuck = bits == HASH_BITS and left == n_records
        total, n_records, bits = left_bytes, left, deeper
    # From the deepest level back: records that point to another have its group.
    for level in range(len(links), -1, -1):
        here = [df for depth, df in results if depth == level]
        if found is not None:
            back = links[level].withColumnRenamed("node", "own").join(found, F.col("root") == found["node"]).drop("root", "node").withColumnRenamed("own", "node")
            here.append(back.select(*found.columns))
        found = here[0]
        for df in here[1:]:
            found = found.unionByName(df)
    return found


def _rows_and_groups(docs: DataFrame, columns: list[str], text: str, doc_id: str, bucket_bytes: int, slice_bytes: int, digest: Column | None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Rows of docs (columns, and with the content on the rows that lead a slice's copies), the groups of these leaders,
    and the names of what is added."""
    names = dict(zip(("content", "h", "doc", "row", "node", "n", "top_doc", "top_row"), fresh_names(docs.columns, "__content", "__h", "__doc", "__row", "__node", "__n", "__top_doc", "__top_row"), strict=True))
    content, h, doc = names["content"], names["h"], names["doc"]
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(*columns, F.col(doc_id).cast("long").alias(doc), whole.alias(content))
    rows = rows.withColumn(h, F.xxhash64(content) if digest is None else digest).select(*columns, doc, h, content)
    added = [names[k] for k in ("row", "node", "content", "n", "top_doc", "top_row")]
    kinds = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.BinaryType() if c == content else T.LongType()) for c in added)])
    found = [f.name for f in kinds.fields]
    spilled = _spill(rows.mapInArrow(lambda batches: _slices(batches, content, h, doc, found, slice_bytes), kinds), "grace-level0")
    records = spilled.filter(F.col(content).isNotNull()).select(*[F.col(names[k]).alias(k) for k in ("node", "h", "content", "n", "top_doc", "top_row")])
    return spilled, _groups_of_records(records, bucket_bytes), names


def grouped(docs: DataFrame, columns: list[str], text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, slice_bytes: int = SLICE_BYTES, digest: Column | None = None) -> DataFrame:
    """columns of every row of docs, and behind them: keep_id (doc_id of the row that stays), group_size, kept (whether
    this row stays) and text_sha256 (lowercase hex of the content); names that columns hold already get underscores after.
    digest: another hash of the column __content than xxhash64, for tests."""
    spilled, groups, names = _rows_and_groups(docs, columns, text, doc_id, bucket_bytes, slice_bytes, digest)
    keep_id, size, kept, sha = fresh_names(columns, "keep_id", "group_size", "kept", "text_sha256")
    own, keep_row, g_keep, g_size, g_sha = fresh_names(spilled.columns, "__own", "__keep_row", "__keep_id", "__size", "__sha")
    groups = groups.select(*[F.col(a).alias(b) for a, b in zip(("node", "keep_id", "keep_row", "group_size", "sha256"), (own, g_keep, keep_row, g_size, g_sha), strict=True)])
    joined = spilled.drop(names["content"]).join(groups, F.col(names["node"]) == F.col(own))
    return joined.select(*columns, F.col(g_keep).alias(keep_id), F.col(g_size).alias(size), (F.col(names["row"]) == F.col(keep_row)).alias(kept), F.col(g_sha).alias(sha))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs that stay, one of each content, with all their columns as they were (a null text stays null)."""
    others = [c for c in docs.columns if c != text]
    (null,) = fresh_names(docs.columns, "__null")
    spilled, groups, names = _rows_and_groups(docs.withColumn(null, F.col(text).isNull()), [*others, null], text, doc_id, bucket_bytes, slice_bytes, None)
    # The content of a row that stays lies with the leader of its slice.
    stays = spilled.drop(names["content"]).join(groups.select(F.col("keep_row").alias(names["content"])).distinct(), F.col(names["row"]) == F.col(names["content"]), "left_semi")
    own, whole = fresh_names(spilled.columns, "__own", "__whole")
    whole_texts = spilled.filter(F.col(names["content"]).isNotNull()).select(F.col(names["node"]).alias(own), F.col(names["content"]).alias(whole))
    back = F.when(~F.col(null), F.col(whole).cast("string")).cast(docs.schema[text].dataType)
    return stays.join(whole_texts, F.col(names["node"]) == F.col(own)).select(*[back.alias(c) if c == text else F.col(c) for c in docs.columns])


def op11_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays of its content.

    Null and empty texts are one content. Whole texts are compared, of any length. A null doc_id is smaller than any
    other; of rows that share text and doc_id one stays. An empty table gives no rows; further columns play no part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grouped(docs, ["doc_id"])


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
