"""Operators against plain versions on small tables with nulls, empty and repeated rows."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidegauge.llm import bpe, chunks, fingerprints, language, minhash, multi_index, packing, pii, quality, sharding, token_files
from tidegauge.session import make_importable

ODD = ["", " ", "  ", "a  b", "a   b", "\n", "a\n\nb", "a \n b", "a\n \nb\n", " lead", "trail ", "it's don't 's", "ÀÉ 中文 𝔘 a\x1cb\t z", "É é İ ß ﬁ Σας", "a\r\nb", "x" * 300 + " 12345", "word.\nWord, the\n", "....,,,, !!! ??", None, "a <|endoftext|> b", "x  <|endoftext|>", "<|endoftext|><|startoftext|>  y\n <|endoftext", "The The. the\nThe,, É!! *"]


@pytest.fixture(scope="module")
def docs(spark):
    make_importable(spark)
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    rows = [(1, base, "en"), (2, base, "en"), (3, near, "en"), (4, None, None), (5, "", "en"), (6, "two words", "de"), (6, "two words", "de"), (None, base, "en"), (7, "Mail a.b@example.com or +1 (136) 555-7479.", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang").selectExpr("*", "1.0D AS score")


@pytest.fixture(scope="module")
def empty(spark):
    make_importable(spark)
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double")


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_memo_equals_the_library(name, keeps_space):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    ids, ends = chunks.library_encoder(public_tokenizers.path(name), keeps_space).encode_batch(pa.array(ODD), 0)
    start = 0
    for text, end in zip(ODD, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        start = end


def test_bpe_equals_tiktoken():
    import tiktoken

    tokens = bpe.load_ranks(bpe.RANKS)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    own = bpe.encoder(bpe.RANKS)
    ids, ends = bpe.piece_memo(bpe.RANKS, public_tokenizers.PATTERN).encode_batch(pa.array(ODD))
    start = 0
    for text, end in zip(ODD, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == want.encode_ordinary(text or "")
        assert own.decode(ids[start:end].tolist()) == (text or "").encode()
        start = end


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True), (7, 7, True)}
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rounds):
    """Families of texts at every likeness around the threshold; without star rounds, blocks alone find the links."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(minhash, "HUB_EDGES", 3)
    monkeypatch.setattr(minhash, "HOT_STRAYS", 2 if rounds else 4_000)
    rng = np.random.default_rng(3)
    texts: list[str] = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(14):
            own = base.copy()
            for at in rng.integers(0, 60, int(rng.integers(0, 5))):
                own[at] = f"x{rng.integers(0, 4)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == dict(enumerate(root)) and 6 < len(set(root)) < len(texts)


def test_near_duplicates_keep_a_borderline_link(spark):
    """40 of 50 shingles in common, so just a link, but signatures that agree in 64 of 100 places, in seven bits too."""
    make_importable(spark)
    words = [f"w18901x{i}" for i in range(49)]
    texts = [" ".join(words), " ".join([*words[:24], "other", *words[25:]])]
    own = minhash.signatures(*minhash.shingle_hashes(pa.array(texts), 5))
    assert (own[0] == own[1]).sum() == 64
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("hot", [2, 4_000])
def test_a_split_bucket_keeps_a_link_that_no_other_band_shows(spark, monkeypatch, hot):
    """8 of 10 words in common, so just a link, and signatures that agree in one whole band of 25. That band's bucket
    holds twelve texts more, each with the words of its four minima; the first of them is its centre."""
    make_importable(spark)
    monkeypatch.setattr(minhash, "HOT_STRAYS", hot)

    def minima(texts):
        return minhash.signatures(*minhash.shingle_hashes(pa.array(texts), 1)).reshape(-1, minhash.BANDS, minhash.ROWS)

    words = [f"p3151x{i}" for i in range(10)]
    pair = [" ".join(words[:9]), " ".join([*words[:8], words[9]])]
    same = np.flatnonzero((np.equal(*minima(pair))).all(axis=1))
    assert len(same) == 1
    band = minima(pair)[0, same[0]]
    hold = [w for w in words[:8] if (minima([w])[0, same[0]] == band).any()]
    free = [w for w in (f"f{i}" for i in range(600)) if (minima([w])[0, same[0]] > band).all()]
    texts = [" ".join([*hold, *free[30 * i : 30 * i + 30]]) for i in range(12)] + pair
    assert (minima(texts)[:, same[0]] == band).all()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 1, 80).collect()}
    assert got == {i: i for i in range(13)} | {13: 12}


@pytest.mark.parametrize("percent", [50, 60, 80, 85, 95, 100])
def test_close_signatures_share_a_part(spark, percent):
    """Signatures that agree in one whole band and in just as many places as a candidate has to."""
    make_importable(spark)
    rng, size = np.random.default_rng(percent), minhash.BANDS * minhash.ROWS
    rows = []
    for i in range(60):
        band = int(rng.integers(0, minhash.BANDS))
        others = np.setdiff1d(np.arange(size), np.arange(band * minhash.ROWS, (band + 1) * minhash.ROWS))
        apart = rng.permutation(others)[: size - minhash.least_agreement(percent)]
        left = rng.integers(0, 128, size)
        right = left.copy()
        right[apart] = (right[apart] + 1) % 128
        rows += [(i, band, left.tolist()), (i, band, right.tolist())]
    pairs = spark.createDataFrame(rows, "pair long, band int, signature array<int>").select("pair", minhash._part_keys(percent).alias("keys"))
    found: dict[int, list[set]] = {}
    for r in pairs.collect():
        found.setdefault(r["pair"], []).append(set(r["keys"]))
    assert len(found) == 60 and all(a & b for a, b in found.values())


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_prefilter_loses_no_more_than_the_banding(percent):
    rest = 1 - percent / 100
    lost = sum(math.comb(100, i) * (1 - rest) ** i * rest ** (100 - i) for i in range(minhash.least_agreement(percent)))
    assert lost <= (1 - (1 - rest) ** minhash.ROWS) ** minhash.BANDS


def test_forest_spans_the_graph():
    rng = np.random.default_rng(8)
    for _ in range(200):
        good = rng.random((int(rng.integers(1, 12)), int(rng.integers(1, 12)))) < rng.random() / 2
        rows, cols = minhash._forest(good)
        assert good[rows, cols].all() and len(rows) <= sum(good.shape)

        def parts(a, b, n=good.shape[0], m=good.shape[1]):
            label = list(range(n + m))
            for _ in label:
                for x, y in zip(a, b, strict=True):
                    label[x] = label[n + y] = min(label[x], label[n + y])
            return label

        assert parts(rows, cols) == parts(*np.nonzero(good))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in minhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100), (103, 100)}


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(docs, path)
    rows = sorted(token_files.digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == 9 and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    one = token_files.read(spark, path, 5, 5).collect()[0]
    assert one["ids"] == [0] and next(r for r in rows if r["doc_id"] == 5)["ids_crc32"] == zlib.crc32(b"\0\0\0\0")


def test_packing(docs, empty):
    rows = packing.pack(packing.pieces(docs)).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(rows) == 9 and packing.pack(packing.pieces(empty)).count() == 0
    lengths = np.random.default_rng(1).integers(1, 2048, 500)
    assert packing.sum_of_squares(lengths, 2048)[0].max() + 1 <= -(-lengths.sum() // 2048) * 1.06


def test_packing_closes_what_groups_leave_open(spark):
    lengths = np.random.default_rng(2).integers(1, 500, 4000).tolist()
    found = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(found, 2048, 1000).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert len(by_sequence) == -(-sum(lengths) // 2048)


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(4)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        text = "".join(rng.choice(list("a.@1-2+ ()%b4\n0"), int(rng.integers(0, 60))))
        want = []
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                    want.append((kind, *m.span()))
        assert pii.base_spans(text) == want


def test_personal_data(docs):
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert (rows[7]["n_email"], rows[7]["n_phone"], rows[4]["spans"]) == (1, 1, "")
    text = "é +1 (826) 555-4081 190.137.223.204 du"
    base, more = pii.find([text], pii.default_model())[0]
    assert base == [("ip", 20, 35)] and more == [("phone", 2, 19)]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[7] == "Mail <email> or <phone>." and masked[4] is None


def test_words_beside_base_spans_gain_no_tag():
    """Whatever stands beside a base span, no word without a digit or @ is taken for personal data."""
    words, texts = list("xyz") + "du an to be or we it no la el de so if in ab der und the foo bar".split(), []
    for seed in (1, 2, 3):
        rng = np.random.default_rng(seed)
        for base in ("a.b@c.de", "190.137.223.204", "4111 1111 1111 1111", "+1 (826) 555-4081", "x_y@mail.example.org"):
            for form in ("{b} {w}", "{w} {b}", "{b}, {w}.", "see {b} {w} {v}", "{v} {w} {b} {w}", "{b} {w} and more words follow here, then {v} again"):
                texts += [form.format(b=base, w=w, v=str(rng.choice(words))) for w in words]
    for text, (_, more) in zip(texts, pii.find(texts, pii.default_model()), strict=True):
        assert all(any(c.isdigit() or c == "@" for c in text[a:b]) for _, a, b in more), (text, more)


FIT = """
import hashlib, sys
sys.path.insert(0, {root!r})
from tidegauge.llm import pii
model = pii.fit(list(pii.training_windows(96)), epochs=1)
print(hashlib.sha256(b"".join(model.p[k].tobytes() for k in sorted(model.p))).hexdigest())
codes = [pii.symbols(t.ljust(pii.WINDOW)) for t, _ in pii.training_windows(64, seed=5)]
import numpy as np
tags, sure = pii.default_model().decode_with_confidence(np.stack([c[: pii.WINDOW] for c in codes]))
print(hashlib.sha256(tags.tobytes() + sure.tobytes()).hexdigest())
"""


def test_network_is_the_same_bits_on_other_kernels():
    """Fitting and reading give the same bits with other BLAS kernels, threads and vector widths of NumPy."""
    root, found = str(Path(pii.__file__).resolve().parents[2]), set()
    for more in ({"OPENBLAS_NUM_THREADS": "1", "OPENBLAS_CORETYPE": "Nehalem", "NPY_DISABLE_CPU_FEATURES": "AVX512F AVX512CD AVX512_SKX AVX2 FMA3"}, {"OPENBLAS_NUM_THREADS": "3", "OPENBLAS_CORETYPE": "Haswell"}, {}):
        found.add(subprocess.run([sys.executable, "-W", "ignore", "-c", FIT.format(root=root)], env=os.environ | more, capture_output=True, text=True, check=True).stdout)
    assert len(found) == 1


@pytest.mark.skipif(not os.environ.get("REFIT"), reason="two to five minutes: REFIT=1 fits the weights anew")
def test_weights_are_those_of_the_recipe():
    want, model = pii.fitted(), pii.default_model()
    assert all((model.p[k] == want[k] * pii.WEIGHT_UNIT).all() for k in want)


def test_windows_of_a_long_text_are_held_in_runs(monkeypatch):
    """Tags do not hang on how many windows are decoded at once, nor memory on the length of a text."""
    model, rng = pii.default_model(), np.random.default_rng(8)
    text = "".join(t + " " for t, _ in pii.training_windows(40, seed=77)) + "".join(map(str, rng.integers(0, 10, 3000))) + " (826) 555-4081"
    base = [pii.base_spans(text)]
    want = pii.added_spans(model, [text], base)
    monkeypatch.setattr(pii, "DECODED", 7)
    assert want[0] and pii.added_spans(model, [text], base) == want
    one = pii.added_spans(model, [text, "no", text], [base[0], [], base[0]])
    assert one == [want[0], [], want[0]]


def test_network_reads_what_holds_no_digit(spark):
    """Addresses in letters alone, in texts without any digit or @, behind more text than a window holds."""
    rng, found = np.random.default_rng(5), 0
    hexes = lambda: "".join(rng.choice(list("abcdef"), 4))
    rows = [(i, "it was found at another place " * (i % 30) + f"at {hexes()}:{hexes()}::{hexes()}:{hexes()} without found place to") for i in range(60)]
    for r, (_, text) in zip(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect(), rows, strict=True):
        start = 30 * (r["doc_id"] % 30) + 3
        found += f"ip:{start}:{start + 20}" in r["spans"].split(",") and r["n_ip"] == 0
    assert found >= 20
    assert {s for t in (rows[29][1], "a" * 5000, "x") for s in pii.window_starts(t)} == set(range(0, 5000 - pii.STRIDE, pii.READ - pii.STRIDE))


def test_fingerprints(spark, docs, empty):
    rows = sorted(fingerprints.with_next(docs.select("doc_id", "text")).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    assert len(rows) == 9 and rows[0]["next_text"] == "two words" and rows[-1]["next_text"].startswith("Mail")
    assert fingerprints.with_next(empty.select("doc_id", "text")).count() == 0
    groups = {r["doc_id"]: r["n_copies"] for r in fingerprints.exact_groups(docs).collect()}
    assert groups[1] == 3 and groups[5] == 2 and groups[3] == 1


def test_sharding_splits_only_what_is_over(spark, docs, empty):
    shards = sharding.directory(docs, 500)
    assert shards.agg({"n_docs": "sum"}).first()[0] == 9 and shards.filter("n_bytes > 500 AND depth < 56").count() == 0
    assert sharding.assign(docs, shards, ["doc_id"]).count() == 9
    assert sharding.assign(empty, sharding.directory(empty), ["doc_id"]).count() == 0


def test_search_recall_and_odd_vectors(spark):
    make_importable(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.search(vectors, vectors.filter("vec_id % 20 = 0"), k=5, centroids=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = 0
    for i in range(0, 600, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:5].tolist()) & {v for _, v in got[i]})
    assert hits / 150 >= 0.9 and len(got) == 30


def test_language_and_quality(spark, docs, empty):
    en = [(i, "the cat and the dog are here with the king", "en") for i in range(40)]
    de = [(100 + i, "der hund und die katze sind hier mit dem", "de") for i in range(40)]
    model = language.train(spark.createDataFrame(en + de, "doc_id long, text string, lang string"))
    assert language.score_texts(model, pa.array(["the kings and cats", "katzen und hunde mit", "123 !!", None]))[0] == ["en", "de", "und", "und"]
    assert language.predict(docs, model).count() == 9 and not language.train(empty).langs
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    texts = spark.createDataFrame([(i, "plain words in a row " * 5 if i % 2 else "###&&& $$$ %%% " * 9) for i in range(200)], "doc_id long, text string")
    scored = quality.predict(texts, quality.train(texts, labels)).collect()
    assert all((r["__quality"] >= 0.5) == bool(r["doc_id"] % 2) for r in scored)
    assert quality.train(empty, labels) is None


def test_quality_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionMil(rng, np.zeros(5), np.ones(5))
    x, counts, y = rng.normal(size=(6, 5)), np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, counts)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in model.gradients(x, counts, y).items():
        at = tuple(0 for _ in g.shape)
        model.p[name][at] += 1e-6
        up = loss()
        model.p[name][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-6)
        model.p[name][at] += 1e-6


def test_edited_texts(spark, tmp_path):
    make_importable(spark)
    rows = [(3, "abcdef"), (2, "ÄÖ xyz"), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()}
    assert got[3]["edited_sha256"] == hashlib.sha256("abcdÄÖ".encode()).hexdigest()
    assert got[2]["edited_sha256"] == hashlib.sha256("ÄÖ x".encode()).hexdigest() and got[1]["near_edited"] == 1.0
