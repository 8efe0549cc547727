"""Sum-of-squares packing of documents into sequences of bounded length.

With N(g) the number of open sequences that have g free places, each piece goes where the sum of N(g)^2 becomes
smallest: into a sequence of gap g >= length, or into a new one. Pieces are dealt into groups of bounded size that are
packed apart from each other, so no task holds more than a group; what each group leaves open is packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.chunks import library_encoder
from tidegauge.llm.common import cut_lineage, table, text_slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 0
CAPACITY = 2048
GROUP_PIECES = 50_000

_PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids with end_id last, cut only where longer than capacity.

    Columns doc_id, copy (tells rows with the same doc_id apart), piece, start, length, ids_crc32 and, if asked for,
    ids. A null text counts as empty: its piece is the end id alone. A null doc_id stays null."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_encoder(vocabulary, False)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids, ends = memo.encode_batch(batch.column("text"), end_id)
                starts = np.concatenate([[0], ends[:-1]])
                total = ends - starts
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                at = starts[row] + start
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False))).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                take = pa.array(row)
                cols = {"doc_id": batch.column("doc_id").take(take), "copy": batch.column("copy").take(take), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(sums, type=pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([at, ends[-1:]]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return rows.mapInArrow(step, _PIECES + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken longest first; no length is over capacity.

    Putting a piece of length s into gap g changes the sum by (1 - 2 N(g)) + (2 N(g - s) + 1), without the last term
    where it fills the sequence; a new sequence costs 2 N(capacity - s) + 1. Ties go to the smallest gap. A new
    sequence is opened only where no open one has room, since few sequences are the aim."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        open_gaps = np.flatnonzero(counts[s:]) + s
        if len(open_gaps):
            after = counts[open_gaps - s]
            change = 2 * (after - counts[open_gaps]) + 2
            change[open_gaps == s] = 1 - 2 * counts[s]
            gap = int(open_gaps[int(np.argmin(change))])
            bin_ = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, bin_ = capacity, opened
            opened += 1
        sequence[i], offset[i] = bin_, capacity - gap
        if gap > s:
            stacks[gap - s].append(bin_)
            counts[gap - s] += 1
    return sequence, offset


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces() with sequence_id and offset. Pieces are dealt evenly into groups of about group_pieces and packed group
    by group; the pieces of all sequences left open are dealt and packed once more. Sequence ids are distinct over all
    groups."""
    found = cut_lineage(found)
    n_groups = max(1, -(-found.count() // group_pieces))
    schema = ", ".join(f"{name} {kind}" for name, kind in found.dtypes) + ", sequence_id long, offset long"
    columns = [*found.columns, "sequence_id", "offset"]

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["copy", "piece"], kind="stable")
        length = rows["length"].to_numpy()
        sequence, offset = sum_of_squares(length, capacity)
        open_ = (np.bincount(sequence, weights=length) < capacity)[sequence]
        return rows.assign(sequence_id=sequence * n_groups + key[0], offset=offset, left_open=open_)[[*columns, "left_open"]]

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        """The new sequences take ids of the old ones, which stay where packing anew does not save any."""
        rows = rows.sort_values(["copy", "piece"], kind="stable")
        ids = np.unique(rows["sequence_id"].to_numpy())
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        if sequence.max() + 1 < len(ids):
            rows = rows.assign(sequence_id=ids[sequence], offset=offset)
        return rows[columns]

    group = F.pmod(F.xxhash64("copy", "piece"), F.lit(n_groups))
    packed = found.groupBy(group.alias("pack_group")).applyInPandas(step, schema + ", left_open boolean")
    if n_groups == 1:
        return packed.drop("left_open")
    packed = cut_lineage(packed)
    rest = packed.filter("left_open").drop("left_open")
    # Whole sequences are dealt, so that each group may reuse its ids.
    group = F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, -(-rest.count() // group_pieces))))
    return packed.filter("NOT left_open").select(*columns).unionByName(rest.groupBy(group.alias("pack_group")).applyInPandas(again, schema))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces and packed."""
    packed = pack(pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
