"""Grace deduplication, divergence of sources and hard negatives: registered queries against plain versions, and the cases
that tables of the driver do not hold."""

import collections
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import divergence, grace_dedup, hard_negatives, registry
from tidegauge.session import make_importable

SF = "/root/testdata/sf0.001"


def write(folder, documents=None, embeddings=None):
    """Tables with further columns whose names the operators use themselves."""
    if documents is not None:
        t = pa.table({"doc_id": pa.array([r[0] for r in documents], pa.int64()), "text": pa.array([r[1] for r in documents], pa.string()), "lang": pa.array([r[2] for r in documents], pa.string()), "source": pa.array([r[3] for r in documents], pa.string())})
        for name in ("node", "bucket", "__content", "kept", "term", "keep_id", "tile", "item"):
            t = t.append_column(name, pa.array([None, "clash"] * len(t), pa.string()).slice(0, len(t)))
        pq.write_table(t, folder / "documents.parquet")
    if embeddings is not None:
        t = pa.table({"vec_id": pa.array([r[0] for r in embeddings], pa.int64()), "label": pa.array([r[1] for r in embeddings], pa.int32()), "embedding": pa.array([r[2] for r in embeddings], pa.list_(pa.float32()))})
        for name in ("x", "cells", "g", "block", "asked"):
            t = t.append_column(name, pa.array([1.5] * len(t)))
        pq.write_table(t, folder / "embeddings.parquet")
    return str(folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_groups(documents):
    by_text = collections.defaultdict(list)
    for doc_id, text in documents:
        by_text[text or ""].append(doc_id)
    out = []
    for text, ids in by_text.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in ids:
            out.append((i, top, len(ids), i == top and stays, sha))
            stays = stays and i != top
    return sorted(out, key=repr)


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (5, "a"), (6, "A"), (7, "é"), (8, "é"), (9, "x" * 3_000_000), (10, "x" * 3_000_000), (11, "x" * 2_999_999 + "y"), (None, "a"), (None, "lone"), (None, "lone"), (12, "a\x00b"), (13, "a\x00c")]


def test_op11_odd_rows(spark, tmp_path):
    sf = write(tmp_path, [(i, t, None, None) for i, t in ODD])
    assert rows(registry.queries()["op11_grace_dedup"](spark, sf)) == plain_groups(ODD)


@pytest.mark.parametrize("name", ["op11_grace_dedup", "op12_source_divergence", "op13_hard_negatives"])
def test_equal_the_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("digest", [None, "weak", "one"])
def test_grace_levels(spark, digest):
    """Small buckets: a hot text is shrunk in parts over several levels, and contents with one hash stay apart."""
    make_importable(spark)
    hot = F.when(F.col("id") % 3 == 0, "hot " * 20).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), (F.col("id") % 701).cast("string")))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), hot.alias("text")).repartition(5)
    hashes = {None: None, "weak": F.pmod(F.xxhash64("__content"), F.lit(3)), "one": F.lit(0).cast("long")}
    got = grace_dedup.grouped(docs, ["doc_id"], bucket_bytes=1 << 14 if digest is None else 1 << 17, slice_bytes=1 << 12, digest=hashes[digest])
    assert rows(got) == plain_groups([tuple(r) for r in docs.collect()])


def test_grace_deduplicate_keeps_rows_as_they_are(spark):
    make_importable(spark)
    docs = spark.createDataFrame([(1, None, "p", 2), (2, "", "q", 3), (3, None, "r", 4), (4, "b", "s", 5), (5, "b", "t", 6)], "doc_id long, text string, node string, kept int")
    assert rows(grace_dedup.deduplicate(docs)) == [(3, None, "r", 4), (5, "b", "t", 6)]
    assert grace_dedup.deduplicate(docs.limit(0)).count() == 0


def test_content_table_probes_and_grows():
    table = grace_dedup.ContentTable()
    contents = [f"c{i}".encode() for i in range(500)]
    assert [table.place(i % 7, c) for i, c in enumerate(contents)] == list(range(500))
    assert [table.place(i % 7, c) for i, c in enumerate(contents)] == list(range(500))


# --- divergence ---
def plain_divergence(documents, min_docs, top):
    texts = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), lang or "", source or "") for t, lang, source in documents]
    inside = lambda c: "a" <= c <= "z" or ord(c) >= 128
    words = [("".join(c if inside(c) else " " for c in t).split(" "), lang, source) for t, lang, source in texts]
    words = [([w for w in ws if w], lang, source) for ws, lang, source in words]
    out = []
    for lang in {x[1] for x in words}:
        docs = collections.Counter(w for ws, g, _ in words if g == lang for w in set(ws))
        kept = sorted((w for w, n in docs.items() if n >= min_docs), key=lambda w: w.encode())
        counts = {s: collections.Counter(w for ws, g, x in words if (g, x) == (lang, s) for w in ws if docs[w] >= min_docs) for s in {x[2] for x in words if x[1] == lang}}
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q = p(whole)
        for s, c in counts.items():
            own = p(c)
            pairs = [(sum(abs(own[w] - p(counts[o])[w]) for w in kept), o) for o in counts if o != s]
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1)]
            terms = [(own[w] - q[w], w) for w in kept if c[w] and own[w] > q[w]]
            out += [(lang, s, "term", w, v, i) for i, (v, w) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top], 1)]
    return sorted(out, key=repr)


def some_documents():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "The", "cat", "Ünder", "日本", "naïve", "x", "zebra", "mots", "a1b", "don't", "É"]
    out = [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 30)), p=[0.3, 0.1] + [0.06] * 10)), str(rng.choice(["en", "fr"])), str(rng.choice(["a", "b", "ç", "z"], p=[0.7, 0.1, 0.1, 0.1]))) for _ in range(160)]
    return out + [(None, None, None), ("", "en", ""), ("only digits 1", "xx", "one"), ("only digits 1", "xx", "two"), (None, "yy", "lone")] + out[:9]


def test_divergence_equals_brute_force(spark):
    make_importable(spark)
    docs = some_documents()
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    want = plain_divergence(docs, 20, 7)
    assert rows(divergence.divergence(df, 20, 7)) == want
    assert rows(divergence.divergence(df, 20, 7, block_cells=3)) == want


def test_divergence_tiles(spark, monkeypatch):
    """Pairs of a block are dealt to several calls where there are many."""
    make_importable(spark)
    monkeypatch.setattr(divergence, "CALL_PAIRS", 4)
    docs = some_documents()
    assert rows(divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string"), 20, 7)) == plain_divergence(docs, 20, 7)


def test_terms_with_one_hash_stay_apart():
    text = "b aa a b cc aa bbb".encode()
    flat = np.frombuffer(text, dtype=np.uint8)
    own, terms = divergence.group_terms(flat, *divergence.boundaries(flat, np.array([0, len(flat)])), digest=lambda t: 1)
    assert [terms[i] for i in own] == text.split()


def test_long_text_is_read_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "WIDE_SLICE_BYTES", 64)
    text = " ".join(f"w{chr(97 + i % 5)}é" for i in range(200)) + "x" * 300
    batch = pa.RecordBatch.from_pydict({"lang": ["l"], "source": ["s"], "text": [text]})
    (got,) = divergence._count(iter([batch]))
    want = collections.Counter(t.encode() for t in text.split())
    assert dict(zip(got["term"].to_pylist(), got["n"].to_pylist(), strict=True)) == want and set(got["docs"].to_pylist()) == {1}


def test_per_billion_is_exact():
    for n, whole in ((0, 1), (5, 5), (7, 9_000_000_000_000_000 - 1), (8_999_999_999_999_998, 9_000_000_000_000_000 - 1)):
        assert divergence.per_billion(np.array([n]), np.array([whole]))[0] == 1 + 10**9 * n // whole


# --- hard negatives ---
def plain_negatives(vectors):
    best = {}
    for v, label, x in vectors:
        if v is None or label is None or not x or any(c is None or not np.isfinite(c) for c in x):
            continue
        row = ((label + 1) % 10 if v % 7 == 0 else label, [int(np.floor(float(np.float32(c)) * 256)) for c in x])
        best[v] = min(best.get(v, row), row)
    score = lambda a, b: sum(p * q for p, q in zip(best[a][1], best[b][1], strict=True))
    out = []
    for a in (v for v in best if v % 50 == 0):
        met = sorted((-score(a, b), b) for b in best if b != a and len(best[b][1]) == len(best[a][1]))
        for ps, p in [(-s, b) for s, b in met if best[b][0] == best[a][0]][:5]:
            near = [(-s, b) for s, b in met if best[b][0] != best[a][0] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, i, b, ps, s) for i, (s, b) in enumerate(near, 1)]
    return sorted(out, key=repr)


def some_vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.2, 0.4, (n, dims))
    x[5::40] = x[5]
    out = [(i, int(rng.choice(10, p=[0.37] + [0.07] * 9)), v.tolist()) for i, v in enumerate(x)]
    odd = [(n, 1, None), (n + 1, None, [1.0] * dims), (None, 1, [1.0] * dims), (n + 2, 1, [float("nan")] * dims), (n + 3, 1, [float("inf")] + [0.0] * (dims - 1)), (n + 4, 1, []), (n + 5, 1, [0.5] * (dims - 1) + [None]), (50, 2, [0.1] * dims), (7, 3, [0.3] * (dims - 1)), (n + 6, 4, [40_000.0] + [0.1] * (dims - 1)), (n + 7, 4, [0.0] * dims)]
    return out + odd


def test_op13_equals_brute_force(spark, tmp_path):
    vectors = some_vectors(400, 9, 1)
    want = plain_negatives(vectors)
    assert want and rows(registry.queries()["op13_hard_negatives"](spark, write(tmp_path, embeddings=vectors))) == want


@pytest.mark.parametrize(("cells", "block"), [(256, 37), (8, 64)])
def test_negatives_in_blocks_and_coarse_cells(spark, tmp_path, cells, block):
    make_importable(spark)
    vectors = some_vectors(300, 6, 2)
    df = spark.read.parquet(write(tmp_path, embeddings=vectors) + "/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    used = hard_negatives.usable(df.withColumn("label", label))
    assert rows(hard_negatives.mine(used, used.filter("vec_id % 50 = 0"), cells=cells, block_rows=block)) == plain_negatives(vectors)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-300, 300, (200, 12)), rng.integers(-300, 300, (7, 12))
    x[0, 0] = 100_000
    edges = hard_negatives.cells_of(x.min(axis=0), x.max(axis=0), x.mean(axis=0), x.std(axis=0), 16)
    cells = np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], side="right") for d in range(12)], axis=1).astype(np.uint8)
    bounds = hard_negatives.Bounds(cells, edges, q)
    assert ((bounds.low <= q @ x.T) & (q @ x.T <= bounds.high)).all() and (bounds.high - bounds.low).mean() < 0.25 * np.abs(q @ x.T).max()


def test_huge_components(spark, tmp_path):
    make_importable(spark)
    far = write(tmp_path, embeddings=[(0, 1, [1e20, 0.0]), (1, 1, [1.0, 1.0])])
    with pytest.raises(Exception, match="beyond 2"):
        registry.queries()["op13_hard_negatives"](spark, far).collect()
