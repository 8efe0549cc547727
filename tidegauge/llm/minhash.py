"""Near-duplicate detection by MinHash: banding, signature check, exact check, connected components.

Documents with equal shingle sets are one node, so copies cost nothing after the first step. A node's signature holds
the minima of many universal hash functions over its set; nodes that agree in a whole band share a bucket. Within a
bucket no list of all pairs is made. Star rounds compare each member with the bucket's centre; a later round, with
other centres, compares only members whose component still differs from the centre's. At the end, members outside
their bucket's commonest component (few, since copies of one text join it by their first links) are compared with all
members of other components there, so that every bucket is settled for each pair of components. That is done block by
block: first on signatures, where each block gives a spanning forest of the pairs that agree closely enough, and then
within the clusters so found on whole sets, where each block gives a spanning forest of true links. Before that, a
candidate is checked by signature and then on the full sets. Components come from alternating large-star and small-star.
A bucket with very many members outside its commonest component is first split into overlapping parts, if that saves
comparisons. The places outside its band are dealt to so many groups that two signatures close enough to be candidates
differ in one place at most of some group; a part holds the members that agree in a group but for one place. So no
candidate is lost, and the result is the same with the split and without it.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut_lineage, partitions, remove, stored, table, text_slices

WORDS, PERCENT = 5, 80
BANDS, ROWS = 25, 4
#: More rounds lose or win no link, as the blocks settle what is left; they only add jobs.
STAR_ROUNDS = 1
SEED = 17
#: Members of a bucket that one task compares with as many others.
BLOCK = 1_000
#: Small groups are dealt together until they weigh this many blocks, since each call of the comparison has its price.
SIGNATURE_BLOCKS, SET_BLOCKS = 8, 1
#: A bucket with more members than this outside its commonest component is split, if so many of its members, tried
#: first, show that the parts at least halve the comparisons. Neither changes the result; at 20,000 parts cost more.
HOT_STRAYS, HOT_TRIED = 100_000, 256
#: Tasks of a comparison at most.
MAX_TASKS = 20_000
#: Nodes with more edges meet their least neighbour by broadcast, not in one task.
HUB_EDGES = 500
#: Texts of more bytes are shingled in parts.
LONG_BYTES = 4 << 20
#: Shingles of the members of a cluster that one task compares with as many others (8 bytes each).
BLOCK_SHINGLES = 1_000_000
#: Ids that may be broadcast (8 bytes each) when texts of some documents are fetched.
MAX_BROADCAST_IDS = 200_000

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ANY_GAP = re.compile(rb"[\x20\x09-\x0d]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of all texts in a row (with repeats), and the bounds of each text.

    A-Z become lower case, words are runs of anything but the six ASCII white spaces. A text of fewer than k words has
    its whole sequence as one shingle; one without words (or null) has none."""
    wide = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    ends = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = _LOWER[np.frombuffer(wide.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    n = len(wide)
    in_word = ~_GAP[raw]
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    cuts = ends[:-1][ends[:-1] < len(raw)]
    begins[cuts] = in_word[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    # A word's hash: sum over its bytes of a number for the byte times one for the place, mixed with its length.
    word = np.cumsum(begins)[in_word] - 1
    place = np.flatnonzero(in_word) - starts[word]
    at_byte = _BYTE[raw[in_word]] * (_PLACE[place & 0xFFF] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
    word_starts = np.flatnonzero(np.diff(word, prepend=-1))
    words = _mix(np.add.reduceat(at_byte, word_starts) + np.diff(np.append(word_starts, len(word))).astype(np.uint64))
    per_text = np.diff(np.searchsorted(starts, ends))
    first = np.cumsum(per_text) - per_text
    full = np.maximum(per_text - k + 1, 0)
    short = (per_text > 0) & (per_text < k)
    counts = full + short
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    index = np.repeat(first - (np.cumsum(full) - full), full) + np.arange(full.sum())
    value = np.zeros(len(index), dtype=np.uint64)
    for j in range(k):
        value += words[index + j] * _WORD[j % 64] + np.uint64(j // 64)
    is_short = np.repeat(short, counts)
    out[~is_short] = _mix(value)
    for t in np.flatnonzero(short):
        own = words[first[t] : first[t] + per_text[t]]
        length = np.array([len(own)], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        out[bounds[t]] = _mix((own * _WORD[np.arange(len(own)) % 64]).sum(keepdims=True) + length)[0]
    return out, bounds


def distinct_shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 1 and len(raw := texts[0].as_buffer() or b"") > LONG_BYTES:
        yield _of_long_text(raw, k)
        return
    hashes, bounds = shingle_hashes(texts, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(hashes[a:b])


def _of_long_text(raw: pa.Buffer, k: int) -> np.ndarray:
    """Parts end between words and begin with the last k - 1 words of the part before."""
    found, start, view = [np.empty(0, dtype=np.uint64)], 0, memoryview(raw)
    gap = ~np.isin(np.arange(256), np.flatnonzero(_GAP))
    while start < len(view):
        size = LONG_BYTES // 2
        while True:
            m = _ANY_GAP.search(view, start + size) if start + size < len(view) else None
            end = m.start() if m else len(view)
            in_word = gap[np.frombuffer(view[start:end], dtype=np.uint8)]
            begins = np.flatnonzero(in_word & ~np.concatenate([[False], in_word[:-1]]))
            if len(begins) >= k or end == len(view):
                break
            size *= 2
        if len(begins) >= k or start == 0:
            part = pa.array([bytes(view[start:end])], type=pa.large_binary()).cast(pa.large_string())
            found.append(np.unique(shingle_hashes(part, k)[0]))
        if end == len(view):
            break
        start += int(begins[len(begins) - k + 1]) if k > 1 else end - start
    return np.unique(np.concatenate(found))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) minima of (a x + b mod 2^64) >> 32 over each text's shingles; empty texts must be left out."""
    out = np.empty((len(bounds) - 1, len(_A)), dtype=np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, i] = np.minimum.reduceat((hashes * a + b) >> np.uint64(32), bounds[:-1])
    return out


@functools.lru_cache
def least_agreement(percent: int) -> int:
    """Signatures that agree in fewer places are not checked further. By the binomial law that loses a pair just at
    percent no more often than the banding does, which is when no band of it agrees."""
    p, n, lost = percent / 100, BANDS * ROWS, 0.0
    for places in range(n):
        lost += math.comb(n, places) * p**places * (1 - p) ** (n - places)
        if lost > (1 - p**ROWS) ** BANDS:
            return places
    return n


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def shingle_nodes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, low, high, signature) of each document; low and high are a 128-bit digest of the
    set, null like the signature where the set is empty. text_hash tells rows with one doc_id apart."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets = list(distinct_shingles(batch.column("text"), k))
                n = len(sets)
                sizes, low, high, raw = np.array([len(x) for x in sets], dtype=np.int64), [None] * n, [None] * n, [None] * n
                full = np.flatnonzero(sizes).tolist()
                if full:
                    own = signatures(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])]))
                    for i, signature in zip(full, own, strict=True):
                        low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), dtype=np.int64).tolist()
                        raw[i] = signature.view(np.int32).tolist()
                cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), pa.array(low, type=pa.int64()), pa.array(high, type=pa.int64()), pa.array(raw, type=pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n_shingles", "low", "high", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("text_hash"))
    return rows.mapInArrow(step, "doc_id long, text_hash long, n_shingles long, low long, high long, signature array<int>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, members): the distinct shingle hashes of each document."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets = [x.view(np.int64) for x in distinct_shingles(batch.column("text"), k)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, dtype=np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "members"])

    return docs.select("node", "text").mapInArrow(step, "node long, members array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node of its component. Alternates large-star
    and small-star until the edges are stars; each round is stored, nothing is collected but a count and a sum."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    spark, before = edges.sparkSession, None
    edges, path = stored(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges, next_path = stored(small, "edges")
        remove(spark, path)
        remove(spark, least_path)
        path = next_path
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m of least(a, m, n). The centre of a large star has as many edges as its component has nodes, so
    nodes of many edges are broadcast, in a number that is checked, and their edges stay where they are."""
    hubs = least.filter(F.col("n") > HUB_EDGES).select("a", "m")
    n = hubs.count()
    if not 0 < n <= MAX_BROADCAST_IDS:
        return edges.join(least.select("a", "m"), "a")
    rest = least.filter(F.col("n") <= HUB_EDGES).select("a", "m")
    others = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti")
    return edges.join(F.broadcast(hubs), "a").select("a", "b", "m").unionByName(others.join(rest, "a").select("a", "b", "m"))


def _hot(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, __parts) of the keys that have more than HUB_EDGES rows, and into how many parts they go; None if there are
    none, or more than may be broadcast. rows should be stored: they are read for this alone."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > HUB_EDGES)
    many = cut_lineage(many.select(*keys, F.ceil(F.col("__n") / HUB_EDGES).cast("int").alias("__parts")))
    return many if 0 < many.count() <= MAX_BROADCAST_IDS else None


def _spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], deal: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with the facts of their keys, one row a key. Rows of a hot key are dealt to its parts, each of which gets the
    facts: hot keys and their numbers of parts are broadcast, but never the facts."""
    if hot is None:
        return rows.join(facts, keys, how)
    parts = F.coalesce("__parts", F.lit(1))
    placed = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(deal, parts).cast("int")).drop("__parts")
    spread = facts.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return placed.join(spread, [*keys, "__part"], how).drop("__part")


def _fetch(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose key is in ids; ids are broadcast if there are few, else both sides are shuffled."""
    ids = ids.select(F.col("node").alias(key))
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, key, "left_semi")


def _fetch_texts(texts: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The text that stands for each node in ids: of several texts with one doc_id, the one whose set is the node's."""
    wanted = cut_lineage(ids.select("node").join(nodes.select("node", "text_hash"), "node"))
    return texts.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted, ["node", "text_hash"], "left_semi")


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) of pairs whose sets meet 100 * intersection >= percent * union. Signatures rule out the bulk."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    known = _fetch(nodes.select("node", "n_shingles", "signature"), "node", ids)
    side = lambda x: known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    sizes_fit = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    hot = {x: _hot(pairs, [x]) for x in "ab"}
    met = _spread_join(pairs, side("a"), ["a"], F.xxhash64("b"), hot["a"]).filter("n_a > 0")
    near = _spread_join(met, side("b"), ["b"], F.xxhash64("a"), hot["b"]).filter(sizes_fit & (agree >= F.lit(least_agreement(percent))))
    near = cut_lineage(near.select("a", "b"))
    ids = cut_lineage(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = shingle_sets(_fetch_texts(texts, nodes, ids), k)
    whole = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}"))
    both = F.size(F.array_intersect("m_a", "m_b")).cast("long")
    # What is hot among the pairs that are left was hot among all.
    met = _spread_join(_spread_join(near, whole("a"), ["a"], F.xxhash64("b"), hot["a"]), whole("b"), ["b"], F.xxhash64("a"), hot["b"])
    checked = met.select("a", "b", (F.size("m_a") + F.size("m_b")).cast("long").alias("n"), both.alias("both"))
    return cut_lineage(checked.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n") - F.col("both"))).select("a", "b"))


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _forest(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the bipartite graph good: fewer edges than rows and columns."""
    free_row, free_col = np.ones(good.shape[0], dtype=bool), np.ones(good.shape[1], dtype=bool)
    out_row, out_col = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for start in np.flatnonzero(good.any(axis=1)).tolist():
        rows = np.array([start] if free_row[start] else [], dtype=np.int64)
        free_row[start] = False
        while len(rows):
            open_ = good[rows] & free_col
            cols = np.flatnonzero(open_.any(axis=0))
            out_row.append(rows[open_[:, cols].argmax(axis=0)] if len(cols) else cols)
            out_col.append(cols)
            free_col[cols] = False
            open_ = good[:, cols] & free_row[:, None]
            rows = np.flatnonzero(open_.any(axis=1))
            out_row.append(rows)
            out_col.append(cols[open_[rows].argmax(axis=1)] if len(rows) else rows)
            free_row[rows] = False
    return np.concatenate(out_row), np.concatenate(out_col)


def _forest_of_strays(placed: DataFrame, group: str, payload: str, weight: Column, limit: int, blocks: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b) over placed(group, node, root, payload): a spanning forest, block by block, of the pairs that share a
    group, differ in root and are near. Members outside their group's commonest component are dealt against all
    members, both in blocks of about limit by weight. A group of one block shares its call with others, up to the weight
    of so many blocks; each call has a task of its own as far as MAX_TASKS goes."""
    placed = placed.withColumn("weight", weight.cast("long"))
    hubs = _strays(placed, group)
    in_blocks = lambda w: F.greatest(F.ceil(w / F.lit(limit)), F.lit(1)).cast("int")
    hubs = hubs.select(group, "hub", "w", in_blocks(F.col("strays")).alias("a_blocks"), in_blocks(F.col("w")).alias("b_blocks"))
    hubs = cut_lineage(hubs.withColumn("solo", F.col("a_blocks") * F.col("b_blocks") > 1))
    size = hubs.agg(F.sum(F.when(~F.col("solo"), F.col("w"))).alias("small"), F.sum(F.when(F.col("solo"), F.col("a_blocks").cast("long") * F.col("b_blocks"))).alias("solo")).first()
    n_shared = max(1, -(-(size["small"] or 0) // (blocks * limit)))
    n_tasks = max(partitions(placed.sparkSession), min(MAX_TASKS, n_shared + (size["solo"] or 0)))
    deal = F.when(F.col("solo"), F.col(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(n_shared)))
    mixed = cut_lineage(placed.join(hubs.drop("w"), group).withColumn("stray", F.col("root") != F.col("hub")).withColumn("deal", deal))
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own, keys = ["solo", "deal", group, "node", "root", "stray", payload], ["solo", "deal", "i", "j"]
    left = mixed.filter("stray").select(*own, block(F.col("a_blocks")).alias("i"), every(F.col("b_blocks")).alias("j"))
    # Names of their own: both sides stem from one table, and a cogroup tells columns apart by where they come from.
    right = mixed.select(*[F.col(c).alias(f"m_{c}") for c in own], every(F.col("a_blocks")).alias("m_i"), block(F.col("b_blocks")).alias("m_j"))

    def compare(strays: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if not strays.empty and not members.empty:
            strays, members = strays.sort_values(group, kind="stable"), members.sort_values(f"m_{group}", kind="stable")
            own, theirs = strays[group].to_numpy(), members[f"m_{group}"].to_numpy()
            node_a, root_a, pay_a = (strays[c].to_numpy() for c in ("node", "root", payload))
            node_b, root_b, stray_b, pay_b = (members[f"m_{c}"].to_numpy() for c in ("node", "root", "stray", payload))
            names, first = np.unique(own, return_index=True)
            last = np.append(first[1:], len(own))
            for a, b, x, y in zip(first, last, np.searchsorted(theirs, names), np.searchsorted(theirs, names, side="right"), strict=True):
                apart = root_a[a:b, None] != root_b[x:y]
                apart &= ~stray_b[x:y] | (node_a[a:b, None] < node_b[x:y])
                if apart.any():
                    i, j = _forest(near(pay_a[a:b], pay_b[x:y]) & apart)
                    out_a.append(node_a[a:b][i])
                    out_b.append(node_b[x:y][j])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    left = left.repartition(n_tasks, *keys)
    right = right.repartition(n_tasks, *[f"m_{c}" for c in keys])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"m_{c}" for c in keys])).applyInPandas(compare, "a long, b long")


def _strays(placed: DataFrame, group: str) -> DataFrame:
    """(group, hub, w, strays) of groups with several components: the commonest one, the weight of all members and of
    those outside it."""
    by_root = placed.groupBy(group, "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    found = by_root.groupBy(group).agg(F.max_by(F.struct("root", "w"), F.struct("n", "root")).alias("hub"), F.count("*").alias("k"), F.sum("w").alias("w")).filter("k > 1")
    return found.select(group, F.col("hub.root").alias("hub"), "w", (F.col("w") - F.col("hub.w")).alias("strays"))


def _part_keys(percent: int) -> Column:
    """Keys of signature, one for each place outside band. Of two signatures in a bucket that agree in
    least_agreement(percent) places, d places at most differ, all outside the band. In d // 2 + 1 groups of places some
    group has no two of them, so the key that leaves out the one (or any) place of that group is the same for both."""
    others, groups = (BANDS - 1) * ROWS, (BANDS * ROWS - least_agreement(percent)) // 2 + 1
    cuts = [others * i // groups for i in range(groups + 1)]
    spans = [F.struct(F.lit(at).alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for at in range(a, b)]
    rest = F.concat(F.slice("signature", 1, F.col("band") * ROWS), F.slice("signature", F.col("band") * ROWS + ROWS + 1, others))
    return F.transform(F.array(*spans), lambda x: F.xxhash64(x["at"], F.slice(rest, x["a"] + 1, x["at"] - x["a"]), F.slice(rest, x["at"] + 2, x["b"] - x["at"] - 1)))


def _split_hot(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """placed(bucket, node, root) with hot buckets replaced by their parts, where these save comparisons. nodes hold the
    signatures that are compared; every pair of them that is near is together in a part."""
    strays = lambda rows, group: _strays(rows.withColumn("weight", F.lit(1)), group).withColumn("pairs", F.col("strays").cast("double") * F.col("w"))
    hot = cut_lineage(strays(placed, "bucket").filter(F.col("strays") > HOT_STRAYS).select("bucket"))
    n = hot.count()
    if n == 0:
        return placed
    few = lambda buckets: F.broadcast(buckets) if n <= MAX_BROADCAST_IDS else buckets
    signed = nodes.select("node", "brief", F.posexplode(_bands()).alias("band", "bucket")).join(few(hot), "bucket")
    members = cut_lineage(placed.join(few(hot), "bucket").join(signed, ["bucket", "node"]).select("bucket", "node", "root", "band", F.col("brief").alias("signature")))
    parts = lambda rows: rows.select("bucket", "node", "root", F.explode(_part_keys(percent)).alias("part")).withColumn("part", F.struct("bucket", "part"))
    tried = cut_lineage(members.withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))).filter(F.col("turn") <= HOT_TRIED))
    after = strays(parts(tried), "part").groupBy(F.col("part.bucket").alias("bucket")).agg(F.sum("pairs").alias("after"))
    worse = strays(tried, "bucket").join(after, "bucket").filter(F.col("after") * 2 > F.col("pairs")).select("bucket")
    split = cut_lineage(hot.join(worse, "bucket", "left_anti"))
    whole = placed.join(few(split), "bucket", "left_anti").select("bucket", "node", "root")
    return cut_lineage(whole.unionByName(parts(members.join(few(split), "bucket")).select(F.xxhash64("part").alias("bucket"), "node", "root")))


def _signatures_near(percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x, y = np.stack(left), np.ascontiguousarray(np.stack(right).T)
        agree = np.zeros((len(x), y.shape[1]), dtype=np.uint8)
        for i in range(len(_A)):
            agree += x[:, i, None] == y[i]
        return agree >= least_agreement(percent)

    return near


def _sets_near(percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """100 * intersection >= percent * union, on whole sets; none is empty."""

    def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n_left, n_right = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
        known, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        cut = int(n_left.sum())
        own, others, starts = np.split(codes[:cut], np.cumsum(n_left)[:-1]), codes[cut:], np.cumsum(n_right) - n_right
        marked, out = np.zeros(len(known), dtype=np.uint8), np.zeros((len(left), len(right)), dtype=bool)
        for i, mine in enumerate(own):
            marked[mine] = 1
            both = np.add.reduceat(marked[others], starts, dtype=np.int64)
            out[i] = 100 * both >= percent * (n_left[i] + n_right - both)
            marked[mine] = 0
        return out

    return near


def _last_links(placed: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join every two components with a link between members of a bucket. Signatures first gather
    such members into clusters; each cluster's sets are then compared whole. Neither step lists all pairs."""
    # Seven bits of each minimum: agreement can only be overrated, so no candidate is lost, and rows are a quarter as wide.
    brief = F.transform("signature", lambda x: x.bitwiseAND(F.lit(127)).cast("byte"))
    close = _split_hot(placed, nodes.withColumn("brief", brief), percent).join(nodes.select("node", brief.alias("signature")), "node")
    clusters = components(_forest_of_strays(close, "bucket", "signature", F.lit(1), BLOCK, SIGNATURE_BLOCKS, _signatures_near(percent)))
    clusters = cut_lineage(clusters.select("node", F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster"))).distinct())
    sets = shingle_sets(_fetch_texts(texts, nodes, clusters), k)
    whole = clusters.join(placed.select("node", "root").distinct(), "node").join(sets, "node")
    return _forest_of_strays(whole, "cluster", "members", F.size("members"), BLOCK_SHINGLES, SET_BLOCKS, _sets_near(percent))


def _bands() -> Column:
    """The buckets of a signature, one a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * ROWS + 1, ROWS)))


def links(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that are linked with another one."""
    rows = nodes.filter("n_shingles > 0").select("node", F.explode(_bands()).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    rows = cut_lineage(rows.join(shared, "bucket").select("bucket", "node"))
    edges: DataFrame | None = None
    tried: DataFrame | None = None
    roots: DataFrame | None = None

    def add(found: DataFrame) -> None:
        nonlocal edges, roots
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges)

    def settle(pairs: DataFrame) -> None:
        nonlocal tried
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if pairs.isEmpty():
            return
        add(verify(pairs, nodes, texts, k, percent))

    for turn in range(STAR_ROUNDS):
        placed = _with_roots(rows, roots)
        if turn:
            open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
            placed = placed.join(open_buckets, "bucket")
        order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
        centre = placed.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), order).alias("c"))
        pairs = placed.join(centre, "bucket").filter(F.col("root") != F.col("c.root"))
        settle(pairs.select(F.col("node").alias("a"), F.col("c.node").alias("b")))
    add(cut_lineage(_last_links(cut_lineage(_with_roots(rows, roots)), nodes, texts, k, percent)))
    return roots


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of docs. Documents with at least percent
    hundredths of their k-word shingles in common are linked; component_id is the smallest doc_id reachable. A text
    without words is linked with nothing. A row's class is that of its own text, also where rows with one doc_id differ;
    should such a doc_id be the smallest of several texts, near copies are sought for the one with most shingles (then
    the largest digest) and the others are linked with equal sets alone. A null doc_id is linked with nothing: its
    component is null and it is kept."""
    prints = cut_lineage(shingle_nodes(docs, k))
    with_words = prints.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = with_words.groupBy("low", "high").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"))
    chosen = sets.groupBy("node").agg(F.max(F.struct("n_shingles", "low", "high")).alias("s")).select("node", "s.low", "s.high")
    # The document is part of the key, so copies of one text go to many tasks.
    firsts = with_words.join(chosen.withColumn("doc_id", F.col("node")), ["doc_id", "low", "high"])
    nodes = cut_lineage(firsts.select("node", "text_hash", "n_shingles", "signature").dropDuplicates(["node"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("text_hash"))
    roots = links(nodes, texts, k, percent)
    linked = chosen.join(roots, "node").select("low", "high", "root")
    of_set = sets.join(linked, ["low", "high"], "left").select("low", "high", F.coalesce("root", "node").alias("root"))
    own = prints.select("doc_id", "text_hash", "n_shingles", "low", "high")
    found = _spread_join(own, of_set, ["low", "high"], F.xxhash64("doc_id", "text_hash"), _hot(prints, ["low", "high"]), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates of all documents: 3-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs by shared shingle, and a recursive closure: too slow on whole large tables, so tests run it on small ones.
ORACLE = None
