"""Each stage of corpus_pipeline and the whole run, against plain versions."""

import hashlib
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidegauge.llm import language, packing, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    copy = next(d for d in docs if d["text"] and len(d["text"].split()) > 60)
    docs += [copy | {"doc_id": 800_001}, copy | {"doc_id": 800_002, "text": copy["text"] + " one more"}, copy | {"doc_id": 800_003, "text": None}, copy | {"doc_id": 800_004, "text": "12 34"}, copy | {"doc_id": 800_005, "text": ""}]
    table = pa.Table.from_pylist(docs)
    for name in ("__quality", "__lang_pred", "__lang_score", "__gone", "__text_hash"):
        table = table.append_column(name, pa.array(["clash"] * len(docs)))
    pq.write_table(table, root / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), root / "labels.parquet")
    return str(root)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def keys(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["text"] is not None)


def test_language_stage(spark, sf):
    docs = docs_of(spark, sf)
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    model = language.train(docs)
    want = []
    for r in docs.select("doc_id", "text").collect():
        names, score = language.score_texts(model, pa.array([r["text"]], type=pa.string()))
        if names[0] != "und" and score[0] >= language.MIN_SCORE:
            want.append((r["doc_id"], r["text"]))
    assert keys(kept) == sorted(want) and kept.columns == docs.columns and not {800_003, 800_004, 800_005} & {d for d, _ in keys(kept)}


def test_quality_stage(spark, sf):
    docs = docs_of(spark, sf)
    kept = corpus_pipeline.classify_quality(spark, docs, sf)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"] is not None and model.scores(pa.array([r["text"]]))[0] >= quality.REJECT_BELOW]
    assert keys(kept) == sorted(want) and kept.columns == docs.columns


def plain_classes(rows):
    """Smallest doc_id reachable by links of at least 0.8 over five-word shingles, by comparing all pairs."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in rows if t}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    root = {i: i for i, _ in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_near_duplicate_stage(spark, sf):
    docs = docs_of(spark, sf)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    root = plain_classes(rows)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, _ in rows if root[i] == i} and kept.columns == docs.columns
    assert not {800_001, 800_002} & {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_near_duplicate_stage_drops_rows_not_ids(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (None, a), (8, None)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, a), (7, b), (None, a), (8, None)], key=repr)


def test_privacy_stage(spark, sf):
    docs = docs_of(spark, sf)
    got = {r["doc_id"]: r for r in corpus_pipeline.mask_personal_data(spark, docs, sf).collect()}
    assert len(got) == docs.count()
    model = pii.default_model()
    for r in docs.collect():
        if r["text"] is None:
            assert got[r["doc_id"]]["text"] is None
            continue
        base, more = pii.find([r["text"]], model)[0]
        assert got[r["doc_id"]]["text"] == pii.redact(r["text"], base + more) and got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])


def test_packing_stage(spark, sf):
    docs = docs_of(spark, sf)
    rows = corpus_pipeline.pack(spark, docs, sf).collect()
    want = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces(docs).collect()}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_run_is_its_stages(spark, sf):
    docs = docs_of(spark, sf)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == left and hashlib.sha256(str(sorted(left)).encode()).hexdigest()


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
