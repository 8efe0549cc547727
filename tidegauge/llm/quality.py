"""Quality classifier: gated attention over a document's passages (multiple-instance learning), in NumPy.

A passage is a run of PASSAGE_BYTES of a text's UTF-8 bytes; a text of any length is all its passages. Each is encoded
to a hidden vector; gated attention weights, learned from document labels alone, make the document's vector; a
logistic layer scores it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegauge.llm.common import cut_lineage, fresh_names, table, text_slices

PASSAGE_BYTES = 1024
#: The classifier is fitted on about this many labelled documents, each with its whole text, and on at most this many
#: passages in all, 100 MB on the driver: in the order of a hash, documents are taken while they fit. Only a text that
#: alone would take over a sixteenth of the passages (12 MB) is never one of them.
TRAIN_DOCS = 6000
TRAIN_PASSAGES = 192_000
#: Texts of more bytes are encoded in parts of this many; a whole number of passages.
LONG_BYTES = 4 << 20
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.01, 1e-4, 7
#: In the pipeline, documents below this score go.
REJECT_BELOW = 0.5

N_FEATURES = 256 + 3
_GRAM = 8
_SLOTS = 2048


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in a row, and the number of passages of each text (1 for an empty or null one).

    Features: root shares of the 256 byte values, the share of distinct 8-byte runs within the passage (low where it
    repeats itself), its fill, and the logarithm of the text's number of passages. Repetition over longer distances
    than a passage is not among them."""
    wide = pc.fill_null(texts.cast(pa.large_string()), "")
    wide = pa.concat_arrays([wide])
    bounds = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(wide.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    out = _features(raw, bounds, sizes, counts)
    out[:, 258] = np.log1p(np.repeat(counts, counts)) / 8
    return out, counts


def encode_bytes(raw: np.ndarray, passages: int) -> np.ndarray:
    """Features of the passages of a part of a long text that has so many passages in all."""
    sizes = np.array([len(raw)])
    out = _features(raw, np.array([0, len(raw)]), sizes, -(-sizes // PASSAGE_BYTES))
    out[:, 258] = np.log1p(passages) / 8
    return out


def _features(raw: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(bounds[:-1] - bounds[0], sizes)
    owner = np.repeat(first, sizes) + place // PASSAGE_BYTES
    bytes_in = np.bincount(owner, minlength=total)
    out = np.zeros((total, N_FEATURES), dtype=np.float32)
    shares = np.bincount(owner * 256 + raw, minlength=total * 256).reshape(total, 256)
    out[:, :256] = np.sqrt(shares / np.maximum(bytes_in, 1)[:, None])
    if len(raw) >= _GRAM:
        runs = np.zeros(len(raw) - _GRAM + 1, dtype=np.uint64)
        for k in range(_GRAM):
            runs = runs * np.uint64(0x100000001B3) + raw[k : len(raw) - _GRAM + 1 + k]
        runs = (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
        # Runs that lie whole within a passage, so that its features hang on its own bytes alone.
        at = place[: len(runs)]
        inside = (at % PASSAGE_BYTES <= PASSAGE_BYTES - _GRAM) & (at <= np.repeat(sizes, sizes)[: len(runs)] - _GRAM)
        hit = np.zeros(total * _SLOTS, dtype=bool)
        hit[owner[: len(runs)][inside] * _SLOTS + runs[inside].astype(np.int64)] = True
        distinct = hit.reshape(total, _SLOTS).sum(axis=1)
        out[:, 256] = distinct / np.maximum(_expected(bytes_in), 1)
    out[:, 257] = bytes_in / PASSAGE_BYTES
    return out


def _expected(n: np.ndarray) -> np.ndarray:
    """Slots that n different runs fill on average."""
    return _SLOTS * (1 - np.exp(-n / _SLOTS))


class AttentionMil:
    """score = sigmoid(c . sum_i a_i h_i + d), h = tanh(x W + b), a = softmax(w . (tanh(h V) * sigmoid(h U)))."""

    def __init__(self, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray) -> None:
        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.mean, self.scale = mean, scale
        self.p = {"W": start(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "w": start(GATE), "c": start(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p, first = self.p, np.cumsum(counts) - counts
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (tv * su) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        m = np.add.reduceat(a[:, None] * h, first, axis=0)
        return _sigmoid(m @ p["c"] + p["d"]), {"z": z, "h": h, "tv": tv, "su": su, "a": a, "m": m}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(counts) - counts
        score, k = self.forward(x, counts)
        ds = (score - y) / len(y)
        dm = np.repeat(ds[:, None] * p["c"], counts, axis=0)
        da = (dm * k["h"]).sum(axis=1)
        de = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, first), counts))
        dgate = de[:, None] * p["w"]
        dtv, dsu = dgate * k["su"] * (1 - k["tv"] ** 2), dgate * k["tv"] * k["su"] * (1 - k["su"])
        dh = dm * k["a"][:, None] + dtv @ p["V"].T + dsu @ p["U"].T
        dz = dh * (1 - k["h"] ** 2)
        return {"W": k["z"].T @ dz, "b": dz.sum(axis=0), "V": k["h"].T @ dtv, "U": k["h"].T @ dsu, "w": (k["tv"] * k["su"]).T @ de, "c": k["m"].T @ ds, "d": ds.sum(keepdims=True)}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        long = np.flatnonzero(pc.greater(pc.binary_length(texts), LONG_BYTES).to_numpy(zero_copy_only=False)).tolist()
        if not long:
            return self.forward(*encode_passages(texts))[0]
        out = np.empty(len(texts))
        for i in range(len(texts)):
            out[i] = self._long_score(texts[i].as_buffer()) if i in long else self.forward(*encode_passages(texts.slice(i, 1)))[0][0]
        return out

    def _long_score(self, raw: pa.Buffer) -> float:
        """The score of one long text: its passages' hidden vectors are weighed part by part, against a running maximum."""
        total, p = -(-len(raw) // PASSAGE_BYTES), self.p
        top, weight, mean = -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, len(raw), LONG_BYTES):
            x = encode_bytes(np.frombuffer(raw, dtype=np.uint8)[at : at + LONG_BYTES], total)
            h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
            e = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            higher = max(top, float(e.max()))
            a, old = np.exp(e - higher), np.exp(top - higher)
            top, weight, mean = higher, weight * old + a.sum(), mean * old + a @ h
        return float(_sigmoid((mean / weight) @ p["c"] + p["d"])[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> AttentionMil:
    """Adam on the log loss of documents; y holds 0 and 1."""
    rng = np.random.default_rng(SEED)
    model = AttentionMil(rng, x.mean(axis=0), x.std(axis=0) + 0.02)
    first = np.cumsum(counts) - counts
    one, two = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in own])
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in model.gradients(x[rows], counts[own], y[own]).items():
                g = g + DECAY * model.p[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                model.p[k] -= rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> AttentionMil | None:
    """Fit on labelled documents whose crc32(doc_id) mod 3 is not 1, sampled by hash to about train_docs and to at most
    TRAIN_PASSAGES; None if there is no label of either kind. Where a doc_id has several labels the smallest counts, and
    where it has several texts the one with the smallest hash; so a doc_id is one document, on however many rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate = min(1.0, train_docs / max(1, known.count()))
    place = F.xxhash64("doc_id", F.lit("quality"))
    sample = known.filter(F.pmod(place, F.lit(1_000_000)) < rate * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # About train_docs numbers, whatever the tables hold, so they may be broadcast.
    met = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    passages = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE_BYTES)).cast("long")
    met = cut_lineage(met.withColumn("passages", passages))
    taken, room = [], TRAIN_PASSAGES
    for r in met.filter(F.col("passages") <= TRAIN_PASSAGES // 16).select("doc_id", "passages").orderBy(place, "doc_id").collect():
        if r["passages"] <= room:
            taken.append((r["doc_id"],))
            room -= r["passages"]
    rows = met.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id").select("doc_id", "quality", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                x, counts = encode_passages(batch.column("text"))
                raw = [part.astype(np.float16).tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(raw, type=pa.binary())], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(step, "doc_id long, quality int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["quality"] for r in found], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r["x"], dtype=np.float16).reshape(-1, N_FEATURES) for r in found]
    return fit(np.concatenate(parts).astype(np.float32), np.array([len(x) for x in parts]), y)


def predict(docs: DataFrame, model: AttentionMil | None) -> DataFrame:
    """docs with a score (0 to 1) appended, named __quality or, where docs has such a column, with underscores after.
    Null texts count as empty; without a model each document gets 1."""
    (name,) = fresh_names(docs.columns, "__quality")
    out = StructType([*docs.schema, StructField(name, DoubleType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                score = model.scores(batch.column("text")) if model else np.ones(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return docs.mapInArrow(step, out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = predict(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__quality").alias("score"), F.when(F.col("__quality") >= 0.5, 1).otherwise(0).alias("predicted"))
