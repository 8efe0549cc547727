"""Divergence of sources: how far each source's words lie from its language's and from every other source's.

Texts are read as bytes: a lookup table over concatenated UTF-8 buffers marks the bytes of terms, its edges are the terms'
boundaries, and terms are grouped by xxhash, each compared byte for byte with the first of its group. Counts by (lang,
source, term) are summed in each batch, again before the shuffle and after it. Terms are then dealt to blocks by hash; a
block is a sparse matrix of sources by terms (CSR), whose rows give by reduceat what the block adds to the divergence of
each two sources, and its best terms of each source. No task holds more than a block, whatever the share of a language.

All arithmetic is in integers. Probabilities are per billion, found by long division in base 1000, so that nothing
overflows below 9e15 terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import WIDE_SLICE_BYTES, gather, give_back, stored, table, text_slices

#: A term is kept if so many documents of its language hold it.
MIN_DOCS = 30
#: Terms reported a source; added to each count.
TOP_TERMS = 50
SMOOTH = 5
#: Counts in a block of terms, and pairs of sources that one call reports.
BLOCK_CELLS = 1_000_000
CALL_PAIRS = 2_000_000

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[ord("A") : ord("Z") + 1] = _INSIDE[ord("a") : ord("z") + 1] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def boundaries(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in a buffer of texts; no term crosses an offset."""
    inside = np.concatenate([[False], _INSIDE[flat], [False]])
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[offsets] = True
    change = inside[1:] != inside[:-1]
    return np.flatnonzero(inside[1:] & (change | edge)), np.flatnonzero(inside[:-1] & (change | edge))


def group_terms(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """A number for each term and the terms by number. Terms with one hash are compared with the first of them, byte by
    byte; those that differ are told apart by their bytes."""
    raw = flat.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    lead = first[own]
    same = lengths == lengths[lead]
    asked = np.flatnonzero(same & (lead != np.arange(len(lead))))
    for at in range(0, len(asked), 1 << 16):
        part = asked[at : at + (1 << 16)]
        equal = gather(flat, starts[part], lengths[part]) == gather(flat, starts[lead[part]], lengths[part])
        same[part] = np.logical_and.reduceat(equal, np.cumsum(lengths[part]) - lengths[part])
    terms = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    if not same.all():
        extra: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            term = raw[starts[i] : ends[i]]
            own[i] = extra.setdefault(term, len(terms) + len(extra))
        terms += extra
    return own, terms


def _parts(flat: np.ndarray) -> np.ndarray:
    """Offsets of parts of one long text, cut where no term is."""
    outside = np.flatnonzero(~_INSIDE[flat])
    cuts = outside[np.searchsorted(outside, np.arange(WIDE_SLICE_BYTES, len(flat), WIDE_SLICE_BYTES)).clip(max=max(0, len(outside) - 1))] if len(outside) else outside
    return np.unique(np.concatenate([[0], cuts, [len(flat)]]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group columns, text) in; (group columns, term, n, docs) of each slice of texts out."""
    for batch in batches:
        names = batch.schema.names[:-1]
        for piece in text_slices(batch, batch.schema.names[-1], WIDE_SLICE_BYTES):
            column = piece.column(piece.num_columns - 1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            flat = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
            flat, offsets = _LOWER[flat], offsets - offsets[0]
            if len(piece) == 1 and len(flat) > WIDE_SLICE_BYTES:
                found: dict[bytes, int] = {}
                for a, b in zip((cuts := _parts(flat))[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own, terms = group_terms(flat[a:b], *boundaries(flat[a:b], np.array([0, b - a])))
                    for term, n in zip(terms, np.bincount(own, minlength=len(terms)).tolist(), strict=True):
                        found[term] = found.get(term, 0) + n
                rows, terms, n, docs = [0] * len(found), list(found), list(found.values()), [1] * len(found)
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(rows, type=pa.int64())) for c in names), pa.array(terms, type=pa.binary()), pa.array(n, type=pa.int64()), pa.array(docs, type=pa.int64())], names=[*names, "term", "n", "docs"])
                continue
            starts, ends = boundaries(flat, offsets)
            if not len(starts):
                continue
            own, terms = group_terms(flat, starts, ends)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            in_doc, n = np.unique(doc * len(terms) + own, return_counts=True)
            # A group of the slice is the first row with its values.
            keys: dict[tuple, int] = {}
            group = np.array([keys.setdefault(k, i) for i, k in enumerate(zip(*(piece.column(c).to_pylist() for c in names), strict=True))], dtype=np.int64)
            cell, back = np.unique(group[in_doc // len(terms)] * len(terms) + in_doc % len(terms), return_inverse=True)
            sums = np.zeros(len(cell), dtype=np.int64)
            np.add.at(sums, back, n)
            docs = np.bincount(back, minlength=len(cell))
            yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(cell // len(terms))) for c in names), pa.array(terms, type=pa.binary()).take(pa.array(cell % len(terms))), pa.array(sums), pa.array(docs)], names=[*names, "term", "n", "docs"])
    give_back()


def per_billion(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * n / whole), for 0 <= n <= whole < 9e15."""
    found, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


_PART = "lang string, part string, source string, item binary, value long"


def _block(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """What a block of terms adds to each two sources (part pair), and its best terms of each source (part term)."""
    empty = pa.table({"lang": pa.array([], pa.string()), "part": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.binary()), "value": pa.array([], pa.int64())})
    if not cells.num_rows or not groups.num_rows:
        return empty
    lang, tile, tiles = groups["lang"][0].as_py(), groups["tile"][0].as_py(), groups["tiles"][0].as_py()
    names = sorted(groups["source"].to_pylist())
    order = {s: i for i, s in enumerate(names)}
    size = np.zeros(len(names), dtype=np.int64)
    size[[order[s] for s in groups["source"].to_pylist()]] = groups["n"].to_numpy()
    smooth = SMOOTH * int(groups["kept_terms"][0].as_py())
    whole = size + smooth
    lang_whole = np.int64(int(groups["lang_n"][0].as_py()) + smooth)
    p_none = per_billion(np.full(len(names), SMOOTH, dtype=np.int64), whole)

    coded = cells["term"].combine_chunks().dictionary_encode()
    terms = np.array(coded.dictionary.to_pylist(), dtype=object)
    rank = np.empty(len(terms), dtype=np.int64)
    rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    col = rank[coded.indices.to_numpy()]
    terms = terms[np.argsort(rank)]
    row = np.array([order[s] for s in cells["source"].to_pylist()], dtype=np.int64)
    n = cells["n"].to_numpy()
    by_term = np.argsort(col, kind="stable")
    lang_n = np.add.reduceat(n[by_term], np.flatnonzero(np.diff(col[by_term], prepend=-1)))
    q = per_billion(lang_n + SMOOTH, np.full(len(terms), lang_whole))

    # The matrix: rows are sources, columns terms in the order of their bytes.
    at = np.lexsort((col, row))
    row, col, n = row[at], col[at], n[at]
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    p = per_billion(n + SMOOTH, whole[row])
    held = np.flatnonzero(np.diff(indptr))

    sources, items, values = [], [], []
    for a in range(tile, len(names), tiles):
        own = slice(indptr[a], indptr[a + 1])
        mine = np.full(len(terms), p_none[a])
        mine[col[own]] = p[own]
        # Each other source as if it had none of the terms: from sorted values and their running sums ...
        ordered = np.sort(p[own])
        below = np.concatenate([[0], np.cumsum(ordered)])
        k = np.searchsorted(ordered, p_none)
        far = below[-1] - 2 * below[k] + (2 * k - len(ordered)) * p_none + (len(terms) - len(ordered)) * np.abs(p_none - p_none[a])
        # ... and what the terms that it has change.
        if len(held):
            far[held] += np.add.reduceat(np.abs(p - mine[col]) - np.abs(p_none[row] - mine[col]), indptr[held])
        others = np.flatnonzero(np.arange(len(names)) > a)
        sources += [names[a]] * len(others)
        items += [names[b].encode() for b in others]
        values.append(far[others])
    parts = ["pair"] * len(sources)
    if tile == 0:
        over = p - q[col]
        for a in held.tolist():
            own = np.arange(indptr[a], indptr[a + 1])
            own = own[over[own] > 0]
            best = own[np.lexsort((col[own], -over[own]))[:TOP_TERMS]]
            sources += [names[a]] * len(best)
            items += terms[col[best]].tolist()
            values.append(over[best])
            parts += ["term"] * len(best)
    if not sources:
        return empty
    return pa.table({"lang": pa.array([lang] * len(sources), pa.string()), "part": pa.array(parts, pa.string()), "source": pa.array(sources, pa.string()), "item": pa.array(items, pa.binary()), "value": pa.array(np.concatenate(values), pa.int64())})


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term binary, n, leads): the kept terms of each group that has them; leads marks one row a (lang,
    term). docs: lang, source, text, none null."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumn("docs", F.sum("docs").over(term)).withColumn("leads", F.row_number().over(term.orderBy("source")) == 1)
    return cells.filter(F.col("docs") >= min_docs).drop("docs")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs; see op12_source_divergence. docs: lang,
    source and text, nulls counting as ''. top_terms: at most TOP_TERMS."""
    if top_terms > TOP_TERMS:
        raise ValueError(f"top_terms is at most {TOP_TERMS}")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells, _ = stored(term_counts(docs, min_docs), "divergence-cells")
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("leads").cast("long")).alias("kept_terms"), F.count("*").alias("n_cells"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "kept_terms", "n_cells"])
    groups, _ = stored(groups, "divergence-groups")
    shape = groups.groupBy("lang").agg(F.count("*").alias("n_sources"), F.first("n_cells").alias("n_cells"))
    shape = shape.select("lang", F.ceil(F.col("n_cells") / block_cells).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("n_sources") * F.col("n_sources") / CALL_PAIRS)).cast("int").alias("tiles"))
    shape, _ = stored(shape.filter("blocks > 0"), "divergence-shape")

    tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    left = cells.join(shape, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), tile)
    right = groups.join(shape, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("lang", "source", "n", "lang_n", "kept_terms", "tiles", "block", tile)
    keys = ["lang", "block", "tile"]
    found, _ = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block, _PART), "divergence-parts")

    half = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("item", F.col("item").cast("string"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # Languages without any kept term: each two of their sources, at 0.
    bare = groups.filter("kept_terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.unionByName(none).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    terms = found.filter("part = 'term'").select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against each other source (part pair) and its language (part term).

    Null text, lang and source are ''. Whole texts count, very long ones in parts cut between terms; a document counts
    once for a term however often it holds it, and each row is a document, repeated ones too. Values that tie are ranked
    by the bytes of their item. A language without kept terms has its pairs at value 0 and no terms; a lone source has no
    pairs. An empty table gives no rows; further columns play no part."""
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


#: DuckDB: every kept term of every group, dense.
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
gs AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT gs.lang, gs.source, kept.term, coalesce(n, 0) AS n
          FROM gs JOIN kept USING (lang) LEFT JOIN counts ON counts.lang = gs.lang AND counts.source = gs.source AND counts.term = kept.term),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
p AS (SELECT d.lang, d.source, d.term, d.n,
             1 + (1000000000 * (CAST(d.n AS HUGEINT) + {SMOOTH})) // (t.total + {SMOOTH} * v) AS p
      FROM dense d JOIN totals t ON d.lang = t.lang AND d.source = t.source JOIN vocab ON d.lang = vocab.lang),
lang_n AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
lang_total AS (SELECT lang, sum(n) AS total FROM lang_n GROUP BY lang),
q AS (SELECT l.lang, l.term, 1 + (1000000000 * (CAST(l.n AS HUGEINT) + {SMOOTH})) // (t.total + {SMOOTH} * v) AS q
      FROM lang_n l JOIN lang_total t ON l.lang = t.lang JOIN vocab ON l.lang = vocab.lang),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
