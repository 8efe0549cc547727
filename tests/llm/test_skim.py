"""The network's first reading of windows, in single precision, and the size of packing's slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidegauge.llm import packing, pii
from tidegauge.llm.chunks import ChunkEncoder
from tidegauge.llm.common import SLICE_BYTES


def _texts() -> list[str]:
    mixed = ["".join(w + " " for w, _ in pii.training_windows(40, seed=300 + k)) for k in range(3)]
    plain = "it was found at another place " * 90
    return [*mixed, plain, plain[:1500] + "fe80::ab:cd:ef:ba " + plain[:1500], "", "1" * 2000, *(w for w, _ in pii.training_windows(60, seed=310))]


def test_skimming_leaves_the_same_spans(monkeypatch):
    """Spans are those of reading every window exactly, whatever is skimmed or held at once."""
    model, texts = pii.default_model(), _texts()
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(model, texts, base)
    monkeypatch.setattr(pii, "MARGIN", np.inf)
    want = pii.added_spans(model, texts, base)
    assert got == want and sum(map(len, want)) > 50
    monkeypatch.setattr(pii, "MARGIN", 2.0)
    monkeypatch.setattr(pii, "SKIMMED", 7)
    monkeypatch.setattr(pii, "ROUND", 11)
    assert pii.added_spans(model, texts, base) == want


def test_skimmed_scores_are_near_the_exact_ones():
    model = pii.default_model()
    codes = np.zeros((90, pii.READ), dtype=np.int64)
    for k, text in enumerate(_texts()[:3]):
        for j in range(30):
            own = pii.symbols(text[j * 100 : j * 100 + pii.READ])
            codes[30 * k + j, : len(own)] = own
    exact = model.scores(codes)
    exact = (exact[:, :, 1:] - exact[:, :, :1]).transpose(0, 2, 1)[:, [0, 2, 4, 6, 1, 3, 5, 7]]
    skim = pii.Skim(model)
    assert np.abs(skim.scores(codes) - exact).max() < 0.3
    tagged = model.decode(codes).any(axis=1)
    assert tagged.any() and (skim.gains(codes)[tagged] > 0).all()
    model = pii.LstmCrf()
    model.p["fc"] = model.p["fc"] + 100.0
    assert np.isinf(pii.Skim(model).gains(codes)).all()


def test_windows_of_plain_words_are_skimmed_alone(monkeypatch):
    decoded, exact = [], pii.LstmCrf.decode_with_confidence
    monkeypatch.setattr(pii.LstmCrf, "decode_with_confidence", lambda self, codes: decoded.append(len(codes)) or exact(self, codes))
    plain = "it was found at another place " * 200
    assert pii.added_spans(pii.default_model(), [plain, plain + "(826) 555-4081"], [[], []])[0] == []
    assert 0 < sum(decoded) <= 2 < len(pii.window_starts(plain))


def test_packing_encodes_small_slices(spark, monkeypatch):
    """No call to the encoder gets more text than a small slice, unless one text alone is longer."""
    sizes, encode = [], ChunkEncoder.encode_batch
    monkeypatch.setattr(ChunkEncoder, "encode_batch", lambda self, texts, end_id=None: sizes.append(sum(len(t.as_py()) for t in texts)) or encode(self, texts, end_id))

    class Rows:
        def select(self, *_):  # noqa: ANN202
            return self

        def mapInArrow(self, step, _):  # noqa: ANN001, ANN202, N802
            return step

    text = "many plain words in a row " * 4000
    batch = pa.record_batch({"doc_id": pa.array(range(30), pa.int64()), "text": pa.array([text] * 30), "copy": pa.array(range(30), pa.int64())})
    found = pa.Table.from_batches(list(packing.pieces(Rows())(iter([batch]))))
    assert len(sizes) > 1 and max(sizes) <= SLICE_BYTES
    assert set(found["doc_id"].to_pylist()) == set(range(30))


def test_padding_is_not_skimmed(monkeypatch):
    """Windows that their texts do not fill are read little farther than their texts, and their spans are the same."""
    read, scores = [], pii.Skim.scores
    monkeypatch.setattr(pii.Skim, "scores", lambda self, codes, *pads: read.append(codes.size) or scores(self, codes, *pads))
    texts = [w for w, _ in pii.training_windows(200, seed=320)]
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(pii.default_model(), texts, base)
    assert sum(read) <= len(texts) * (pii.WINDOW + 16) < len(texts) * pii.READ
    monkeypatch.setattr(pii, "MARGIN", np.inf)
    assert got == pii.added_spans(pii.default_model(), texts, base) and sum(map(len, got)) > 20


def test_the_backward_lstm_has_read_padding_that_is_left_out():
    codes = np.zeros((40, pii.READ), dtype=np.int64)
    for k, (text, _) in enumerate(pii.training_windows(40, seed=321)):
        codes[k, : len(text)] = pii.symbols(text)
    skim = pii.Skim(pii.default_model())
    whole, short = skim.scores(codes), skim.scores(codes[:, :112], pii.READ - 112)
    assert np.abs(short - whole[:112]).max() < 0.01
    gains, lengths = skim.gains(codes), np.count_nonzero(codes, axis=1)
    near = gains > -pii.MARGIN
    assert near.sum() > 20 and (skim.gains_of_texts(codes, lengths)[near] > gains[near] - 0.01).all()


def test_skimmed_cells_may_be_large():
    """Cells that count for a whole window leave single precision's powers, and are held within them."""
    model = pii.LstmCrf()
    for way in "fb":
        model.p[f"{way}W"] = np.zeros_like(model.p[f"{way}W"])
        model.p[f"{way}c"] = np.repeat(np.array([12.0, 20.0, 0.0, 6.0]), pii.HIDDEN) * np.repeat([[1, 1, 1, -1], [1, 1, 1, 1]], pii.HIDDEN // 2, axis=0).T.reshape(-1)
    codes = np.ones((5, pii.READ), dtype=np.int64)
    exact = model.scores(codes)
    exact = (exact[:, :, 1:] - exact[:, :, :1]).transpose(0, 2, 1)[:, [0, 2, 4, 6, 1, 3, 5, 7]]
    skim = pii.Skim(model)
    assert skim.fits and np.abs(skim.scores(codes) - exact).max() < 0.1 * np.abs(exact).max()
