"""The registered queries over the smallest driver tables plus odd rows, against plain versions."""

import hashlib
import itertools
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidegauge.llm import bpe, chunks, fingerprints, language, minhash, multi_index, packing, pii, quality, registry, sharding, token_files
from tidegauge.session import make_importable

SF = "/root/testdata/sf0.001"
WORDS = " ".join(f"w{i % 977}é" for i in range(9_000))
ODD = [
    (900_001, None), (900_002, ""), (900_003, "  \n\t "), (900_004, "a <|endoftext|> b  <|startoftext|>"), (900_005, WORDS), (900_006, "x" * 5_000), (900_007, "ＦＵＬＬ  Width ﬁ"),
    (900_008, "full width fi"), (900_009, "É é é tail"), (900_010, "same text"), (900_011, "Same\tTEXT "), (900_012, "+1 (826) 555-4081 190.137.223.204 a.b@c.de 4111 1111 1111 1111"), (900_013, "中文 текст 𝔘"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables: the driver's, with odd documents and columns whose names the operators use themselves."""
    make_importable(spark)
    root = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text", "lang", "source"]).to_pylist()
    docs += [{"doc_id": i, "text": t, "lang": None, "source": "odd"} for i, t in ODD]
    table = pa.Table.from_pylist(docs)
    for name in ("__quality", "__lang_pred", "shard", "depth", "copy", "signature", "file", "part", "ghost", "text_hash", "node"):
        table = table.append_column(name, pa.array(["clash"] * len(docs)))
    pq.write_table(table, root / "documents.parquet")
    for name in ("labels", "embeddings"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), root / f"{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), root / f"{name}.parquet")
    return str(root)


def texts(sf):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def run(spark, name, sf):
    return registry.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


def test_op1_equals_a_plain_scorer(spark, sf):
    from tidegauge.llm.common import table

    model = language.train(table(spark, sf, "documents"))
    rows = {r["doc_id"]: r for r in run(spark, "op1_language_id", sf)}
    known = dict(zip(model.words, model.word_logs, strict=True))
    for doc_id, text in texts(sf).items():
        words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]
        r = rows[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = sum(np.asarray(known[w] if w in known else model.backoff(w), dtype=float) for w in words) * min(len(words), language.EVIDENCE_WORDS) / len(words)
        odds = np.exp(logs - logs.max())
        if "é" not in text:  # a mark is no letter here and part of a word there
            assert r["score"] == pytest.approx((odds / odds.sum()).max(), abs=1e-4) and (r["lang_pred"] == model.langs[int(logs.argmax())] or r["score"] < 0.51)


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in run(spark, "op1_language_id", sf) if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(judged) > 100 and np.mean(judged) >= 0.97


def test_op5_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = {r["doc_id"]: r for r in run(spark, "op5_token_files", sf)}
    for doc_id, text in sorted(texts(sf).items()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert tuple(rows[doc_id]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5_files_can_be_read_in_parts(spark, tmp_path):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60), i -> md5(string(id * 1000 + i))), ' ') AS text").repartition(2)
    path = str(tmp_path / "ids")
    token_files.write(docs, path, row_group_bytes=1 << 18, page_bytes=1 << 14)
    groups = []
    for file in sorted((tmp_path / "ids").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids = next(c for name, c in cols.items() if name.startswith("ids"))
            assert "DELTA_BINARY_PACKED" in ids.encodings and ids.has_offset_index and cols["doc_id"].has_column_index
            groups.append((cols["doc_id"].statistics.min, cols["doc_id"].statistics.max))
    assert len(groups) > 4 and all(a[1] < b[0] for a, b in zip(sorted(groups), sorted(groups)[1:], strict=False))
    part = token_files.read(spark, path, 100, 119)
    assert part.count() == 20 and "doc_id" in part._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:200]
    small = token_files.read(spark, path, with_ids=False)
    assert "ids" not in small._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_op6_equals_the_library_and_packs(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, total = run(spark, "op6_packing", sf), 0
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in texts(sf).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want = [(i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == want
        total += len(ids)
    assert any(len(x) > 2 for x in by_doc.values())
    for places in by_sequence.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by_sequence) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares_equals_a_plain_version(seed):
    lengths = np.random.default_rng(seed).integers(1, 41, 200)
    gaps, got = [], packing.sum_of_squares(lengths, 40)
    want = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s = int(lengths[i])
        count = lambda g: sum(x == g for x in gaps)

        def cost(g, s=s, count=count):
            after = dict.fromkeys({g, g - s}, 0) | {x: count(x) for x in {g, g - s}}
            before = sum(v * v for k, v in after.items() if k)
            after[g] -= 1
            after[g - s] += 1
            return sum(v * v for k, v in after.items() if k) - before

        open_ = sorted({g for g in gaps if g >= s})
        gap = min(open_, key=lambda g: (cost(g), g)) if open_ else 40
        if open_:
            at = max(j for j, g in enumerate(gaps) if g == gap)
        want[i] = 40 - gap
        if open_:
            gaps[at] = gap - s
        else:
            gaps.append(gap - s)
    assert got[1].tolist() == [want[i] for i in range(len(lengths))] and got[0].max() + 1 == len(gaps)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_op7_base_spans_equal_the_patterns(spark, sf):
    rows, added = {r["doc_id"]: r for r in run(spark, "op7_pii", sf)}, 0
    for doc_id, text in texts(sf).items():
        base, r = plain_spans(text or ""), rows[doc_id]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.join_spans(base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        more = [s for s in spans if s not in base]
        assert set(base) <= set(spans) and not any(a < y and x < b for _, a, b in more for _, x, y in base)
        added += len(more)
    assert added >= 1 and "phone:0:17" in rows[900_012]["spans"]


def test_op7_network_on_fresh_windows():
    model, fresh = pii.default_model(), list(pii.training_windows(400, seed=4321))
    base = [pii.base_spans(t) for t, _ in fresh]
    hits = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for (text, gold), own, got in zip(fresh, base, pii.added_spans(model, [t for t, _ in fresh], base), strict=True):
        gold = [s for s in gold if not any(s[1] < y and x < s[2] for _, x, y in own) and s[1] > 0 and s[2] < len(text)]
        for s in got:
            if s[1] > 0 and s[2] < len(text):
                hits[0 if s in gold else 1][s[0]] += 1
        for s in gold:
            hits[2][s[0]] += s not in got
    for kind in pii.KINDS:
        right, wrong, missed = (h[kind] for h in hits)
        assert right >= 10 and right / (right + wrong) >= 0.8 and right / (right + missed) >= 0.85, (kind, right, wrong, missed)


def test_op7_windows_lose_no_span_of_whole_texts(sf):
    """Read by windows over all of a text, the network finds no span with a digit or @ that the windows around these miss."""
    model = pii.default_model()
    some = [t for t in texts(sf).values() if t and re.search("[0-9@]", t)][:12] + ["no digits here at all, only words " * 40]
    everywhere = lambda t: list(range(0, max(1, len(t) - pii.WINDOW + pii.STRIDE), pii.STRIDE))
    base = [pii.base_spans(t) for t in some]
    for text, near, whole in zip(some, pii.added_spans(model, some, base), pii.added_spans(model, some, base, everywhere), strict=True):
        assert {s for s in whole if re.search("[0-9@]", text[s[1] : s[2]])} <= set(near)


def form(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    spaces = "[\\t\\n\\x0b\\f\\r\\x85\\u1680\\u2028\\u2029]"
    return re.sub(" {2,}", " ", re.sub(spaces, " ", folded)).strip(" ")


def check_fingerprints(rows, sf):
    docs = sorted(texts(sf).items(), reverse=True)
    prints = {r["doc_id"]: r for r in rows}
    assert len(prints) == len(docs)
    by_form = {}
    for i, (doc_id, text) in enumerate(docs):
        text, after, r = text or "", docs[(i + 1) % len(docs)][1] or "", prints[doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(form(text) == form(edited)), float(form(text) == form(after)))
        by_form.setdefault(form(text), set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in by_form.values()) and len({p for s in by_form.values() for p in s}) == len(by_form)


def test_op8_equals_a_plain_version(spark, sf):
    check_fingerprints(run(spark, "op8_fingerprints", sf), sf)


def test_op8_tells_clashing_digests_apart(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda form: (F.char_length(form) % 5).cast("string"))
    check_fingerprints(run(spark, "op8_fingerprints", sf), sf)


def test_op8_runs_with_very_many_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        check_fingerprints(run(spark, "op8_fingerprints", sf), sf)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op8_native_plan_has_no_python(spark, sf):
    assert "Python" not in fingerprints.op8_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_op9_equals_a_plain_forward_pass(spark, sf):
    from tidegauge.llm.common import table

    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = {r["doc_id"]: r for r in run(spark, "op9_quality", sf)}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for doc_id, text in texts(sf).items():
        x, _ = quality.encode_passages(pa.array([text], type=pa.string()))
        h = np.tanh((x - model.mean) / model.scale @ model.p["W"] + model.p["b"])
        e = np.exp((np.tanh(h @ model.p["V"]) * sigmoid(h @ model.p["U"])) @ model.p["w"])
        score = float(sigmoid((e / e.sum()) @ h @ model.p["c"] + model.p["d"])[0])
        r = rows[doc_id]
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    judged = [r["predicted"] == label[r["doc_id"]] for r in run(spark, "op9_quality", sf) if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert len(judged) > 50 and np.mean(judged) >= 0.95


def test_op10_equals_tiktoken(spark, sf):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(bpe.RANKS))}, special_tokens={})
    rows = {r["doc_id"]: r for r in run(spark, "op10_byte_bpe", sf)}
    for doc_id, text in texts(sf).items():
        ids = own.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(rows[doc_id]) == (doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    full = {r["doc_id"]: r for r in bpe.encode_decode(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert bytes(full[900_005]["decoded"]) == WORDS.encode() and full[900_001]["ids"] == []


def test_op4_finds_nine_in_ten_at_every_size(spark, sf, tmp_path):
    make_importable(spark)
    rng = np.random.default_rng(9)
    for n in (60, 6_000):
        x = rng.normal(size=(n, 16))
        x[5] = x[4]
        pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), tmp_path / "embeddings.parquet")
        got = {}
        for r in run(spark, "op4_multi_index", str(tmp_path)):
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = 0
        for q in range(0, n, 20):
            s = (x * x[q]).sum(axis=1)
            s[q] = -np.inf
            best = np.lexsort((np.arange(n), -s))[:20]
            own = sorted(got[q])
            assert [r for r, _, _ in own] == list(range(1, 21)) and all(s[v] == pytest.approx(z, abs=1e-12) for _, v, z in own)
            assert own == sorted(own, key=lambda r: (-r[2], r[1]))
            hits += len(set(best.tolist()) & {v for _, v, _ in own})
        assert hits / (len(got) * 20) >= 0.9


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_long_texts_are_encoded_in_parts(monkeypatch, name, keeps_space):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chunks, "LONG_BYTES", 200)
    cases = [WORDS[:3_000], "a  b" * 300, "x" * 900, "  y\n\n" * 200 + " <|endoftext|>  z" * 30, "word, The\n" * 100]
    ids, ends = chunks.library_encoder(public_tokenizers.path(name), keeps_space).encode_batch(pa.array([*cases, "short", None]), 0)
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(name)), 0
    for text, end in zip([*cases, "short", ""], ends.tolist(), strict=True):
        assert ids[start:end].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        start = end


@pytest.mark.parametrize("k", [1, 3, 5])
def test_long_texts_are_shingled_in_parts(monkeypatch, k):
    monkeypatch.setattr(minhash, "LONG_BYTES", 40)
    rng = np.random.default_rng(k)
    for _ in range(200):
        text = "".join(rng.choice(list("ab\n  é"), int(rng.integers(41, 300)))) + " " * int(rng.integers(0, 60))
        hashes, _ = minhash.shingle_hashes(pa.array([text]), k)
        assert next(minhash.distinct_shingles(pa.array([text]), k)).tolist() == np.unique(hashes).tolist()


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality.AttentionMil(rng, np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    long = WORDS * 3
    whole = model.scores(pa.array([long, "short"]))
    monkeypatch.setattr(quality, "LONG_BYTES", 8 * quality.PASSAGE_BYTES)
    assert model.scores(pa.array([long, "short"])) == pytest.approx(whole, abs=1e-9)
    words = language._model(["de", "en"], [("de", 0, "der", 5), ("en", 0, "the", 5), ("en", 0, "w", 1)])
    text = "the der w " * 500
    at_once = language.score_texts(words, pa.array([text, "der"]))
    monkeypatch.setattr(language, "LONG_BYTES", 64)
    in_parts = language.score_texts(words, pa.array([text, "der"]))
    assert in_parts[0] == at_once[0] and in_parts[1] == pytest.approx(at_once[1])


def test_a_very_long_text_goes_through(spark, tmp_path):
    """One text of 9 MB, over every operator's limit, beside a short one."""
    long = " ".join("".join(x) for x in itertools.islice(itertools.product("abcdefghijkmnop", repeat=7), 1_200_000))
    pq.write_table(pa.table({"doc_id": [1, 2], "text": [long, "a short one"], "lang": ["en", "en"]}), tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    make_importable(spark)
    assert {r["doc_id"]: r["n_shingles"] for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles").collect()} == {1: 1_200_000 - 4, 2: 1}
    assert packing.pieces(docs).agg({"length": "sum"}).first()[0] > 1_200_000 and pii.detect(docs).filter("doc_id = 1").first()["n_email"] == 0


def test_write_shards_keeps_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "shards"), 100_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*docs.columns, "shard_"} and back.count() == docs.count() and back.filter("shard <> 'clash' OR depth <> 'clash'").count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    make_importable(spark)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (7, a), (7, b), (9, b), (9, b)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (7, 1, False), (7, 7, True), (9, 7, False), (9, 7, False)]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from tidegauge.llm import common

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_search_ignores_vectors_that_take_no_part(spark):
    make_importable(spark)
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in multi_index.search(vectors, vectors.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]


def test_op3_registered_query_equals_brute_force(spark, tmp_path):
    """All four columns, on families of texts around the threshold, a text with very many copies, and odd rows."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, None if i % 40 == 0 else "" if i % 41 == 0 else "hot text of a few words" if i % 4 == 0 else "Two Words" if i % 43 == 0 else None) for i in range(1, 1500, 3)]
    docs = [(i, t) for i, t in docs if t is not None or i % 40 == 0]
    for family in range(12):
        base = rng.choice(words, 90).tolist()
        for copy in range(9):
            mine = list(base)
            for _ in range(int(rng.integers(0, 6))):
                mine[int(rng.integers(90))] = str(rng.choice(words))
            docs.append((2_000 + family * 9 + copy, " ".join(mine)))
    docs.append((5_000, docs[-1][1]))
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "node": pa.array(["clash"] * len(docs))}), tmp_path / "documents.parquet")
    sets = {}
    for d, t in docs:
        ws = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        sets[d] = {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)
    assert sorted(tuple(r) for r in run(spark, "op3_minhash_dedup", str(tmp_path))) == want


def test_spread_join_deals_hot_keys(spark, monkeypatch):
    make_importable(spark)
    monkeypatch.setattr(minhash, "HUB_EDGES", 10)
    rows = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(130)], "k long, v long")
    facts = spark.createDataFrame([(k, k * 2) for k in [0, 1, *range(90, 100)]], "k long, f long")
    for how in ("inner", "left"):
        want = sorted((tuple(r) for r in rows.join(facts, ["k"], how).collect()), key=repr)
        assert sorted((tuple(r) for r in minhash._spread_join(rows, facts, ["k"], minhash.F.col("v"), minhash._hot(rows, ["k"]), how).collect()), key=repr) == want


def test_op9_one_doc_id_on_many_rows_is_one_document(spark, monkeypatch):
    make_importable(spark)
    docs = spark.range(6000).selectExpr("CASE WHEN id < 5000 THEN 1 ELSE id END AS doc_id", "concat('text number ', id) AS text")
    labels = spark.range(6000).selectExpr("CASE WHEN id < 3000 THEN 1 ELSE id END AS doc_id", "CAST(id % 2 AS INT) AS quality")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, counts, y: seen.append((len(x), len(counts))))
    quality.train(docs, labels, 300)
    assert len(seen) == 1 and seen[0][0] == seen[0][1] and 60 <= seen[0][1] <= 160
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 50)
    quality.train(docs, labels, 300)
    assert seen[1] == (50, 50)


def test_op5_files_follow_doc_id_order_by_number(spark):
    names = spark.createDataFrame([("part-99999-x.parquet",), ("part-100000-x.parquet",)], "file string")
    assert [r["n"] for r in names.select(token_files.part_number("file").alias("n")).orderBy("n").collect()] == [99_999, 100_000]
