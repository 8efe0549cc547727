"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word backs off to its character n-grams, the longest
length first: the mean log frequency of those n-grams that are known at the first length that has any. Of languages with
the same evidence the first by name is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidegauge.llm.common import WIDE_SLICE_BYTES, fresh_names, table, text_slices

#: The model is fitted on about this many documents of each language (all, where there are fewer).
TRAIN_DOCS = 300
#: The commonest languages that are learned, the words and n-grams (by size) that each may keep, and all together; with
#: many languages each keeps an equal share.
MAX_LANGS = 1_000
MAX_WORDS, ALL_WORDS = 60_000, 600_000
MAX_GRAMS, ALL_GRAMS = 30_000, 300_000
GRAM_SIZES = (4, 3, 2, 1)
SMOOTHING = 0.5
#: The score is a softmax over the evidence of at most this many words, so that it does not saturate on long texts.
EVIDENCE_WORDS = 20
UNKNOWN = "und"
MAX_MEMO = 200_000
MIN_SCORE = 0.5
#: Texts of more bytes are scored in parts, cut where no word is.
LONG_BYTES = 8 << 20
_GAP = re.compile(r"[\s0-9.,;:!?]")


@dataclass
class Model:
    """log frequencies by language: words, and n-grams by size. unseen is the value of a word that has no known n-gram."""

    langs: list[str]
    words: list[str]
    word_logs: np.ndarray
    grams: list[dict[str, int]]
    gram_logs: list[np.ndarray]
    key: str = field(default="")

    def backoff(self, word: str) -> np.ndarray:
        padded = f" {word} "
        for size, known, logs in zip(GRAM_SIZES, self.grams, self.gram_logs, strict=True):
            found = [known[g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in known]
            if found:
                return logs[found].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters of all texts in a row ('' where there is none), and the bounds of each text."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(lower, r"\P{L}+")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on documents with a language whose crc32(doc_id) mod 4 is not 2, sampled by hash to about train_docs a
    language. Counts are summed by Spark; the driver gets the most frequent words and n-grams alone."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    have = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(have)
    if not langs:
        return _model([], [])
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / have[k]))]), F.col("lang"))
    sampled = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < rate * 1_000_000)  # null, so dropped, for a language that is not learned

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                of_lang = batch.filter(pc.equal(batch.column("lang"), lang))
                for part in text_slices(of_lang, "text", WIDE_SLICE_BYTES):
                    counted = pc.value_counts(words_of(part.column("text"))[0])
                    for word, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True):
                        if word:
                            total[lang, 0, word] += n
                            padded = f" {word} "
                            for size in GRAM_SIZES:
                                for i in range(len(padded) - size + 1):
                                    total[lang, size, padded[i : i + size]] += n
            if len(total) > 1_000_000:
                yield _counts(total)
                total = Counter()
        yield _counts(total)

    counts = sampled.select("lang", "text").mapInArrow(count, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram"))
    most = F.when(F.col("size") == 0, min(MAX_WORDS, ALL_WORDS // len(langs))).otherwise(min(MAX_GRAMS, ALL_GRAMS // len(langs)))
    kept = counts.withColumn("place", place).filter(F.col("place") <= most).collect()
    return _model(langs, [(r["lang"], r["size"], r["gram"], r["n"]) for r in kept])


def _counts(total: Counter) -> pa.RecordBatch:
    cols = list(zip(*[(*k, n) for k, n in total.items()], strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["lang", "size", "gram", "n"])


def _model(langs: list[str], counts: list[tuple[str, int, str, int]]) -> Model:
    import hashlib

    column = {lang: i for i, lang in enumerate(langs)}

    def logs(size: int) -> tuple[list[str], np.ndarray]:
        own = [(lang, gram, n) for lang, s, gram, n in counts if s == size]
        names = sorted({gram for _, gram, _ in own})
        at = {g: i for i, g in enumerate(names)}
        seen = np.full((len(names), len(langs)), SMOOTHING)
        for lang, gram, n in own:
            seen[at[gram], column[lang]] += n
        return names, np.log(seen / seen.sum(axis=0, keepdims=True)).astype(np.float32)

    words, word_logs = logs(0)
    grams = [logs(size) for size in GRAM_SIZES]
    key = hashlib.sha256(repr((langs, sorted(counts))).encode()).hexdigest()
    return Model(langs, words, word_logs, [{g: i for i, g in enumerate(names)} for names, _ in grams], [x for _, x in grams], key)


class _Memo:
    """Evidence of words seen so far by this Python worker; emptied when it is too large."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array(["", *self.model.words], type=pa.large_string())
        self.logs = np.concatenate([np.zeros((1, len(self.model.langs)), dtype=np.float32), self.model.word_logs])

    def rows(self, words: pa.Array) -> np.ndarray:
        if len(self.keys) > MAX_MEMO + len(self.model.words):
            self.clear()
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        rows = pc.fill_null(at, -1).to_numpy().copy()
        if at.null_count:
            new = coded.dictionary.filter(pc.is_null(at))
            rows[rows < 0] = np.arange(len(self.keys), len(self.keys) + len(new))
            self.logs = np.concatenate([self.logs, np.array([self.model.backoff(w) for w in new.to_pylist()], dtype=np.float32)])
            self.keys = pa.concat_arrays([self.keys, new])
        return rows[coded.indices.to_numpy()]


_MEMOS: dict[str, _Memo] = {}


def _evidence(memo: _Memo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Summed log frequencies by language, and the number of words, of each text."""
    words, bounds = words_of(texts)
    rows = memo.rows(words)
    return np.add.reduceat(memo.logs[rows].astype(np.float64), bounds[:-1], axis=0), np.add.reduceat((rows != 0).astype(np.int64), bounds[:-1])


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > LONG_BYTES // 2 and (m := _GAP.search(text, start + LONG_BYTES // 2)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def score_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text; 'und' and 0 where it has no letter or nothing was learned."""
    if model.key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[model.key] = _Memo(model)
    memo = _MEMOS[model.key]
    n = len(texts)
    if not model.langs or n == 0:
        return [UNKNOWN] * n, np.zeros(n)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    long = pc.greater(pc.binary_length(texts), LONG_BYTES).to_numpy(zero_copy_only=False)
    evidence, letters = _evidence(memo, pc.if_else(pa.array(long), "", texts) if long.any() else texts)
    for i in np.flatnonzero(long).tolist():
        for part in _parts(texts[i].as_py()):
            more, words = _evidence(memo, pa.array([part], type=pa.large_string()))
            evidence[i] += more[0]
            letters[i] += words[0]
    evidence *= (np.minimum(letters, EVIDENCE_WORDS) / np.maximum(letters, 1))[:, None]
    odds = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    best = odds.argmax(axis=1)
    score = np.where(letters > 0, odds.max(axis=1) / odds.sum(axis=1), 0.0)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), letters.tolist(), strict=True)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two columns appended: language and score, named __lang_pred and __lang_score or, where docs has such
    columns, with underscores after. Only text is used; null and empty texts give 'und', 0."""
    pred, scored = fresh_names(docs.columns, "__lang_pred", "__lang_score")
    out = StructType([*docs.schema, StructField(pred, StringType()), StructField(scored, DoubleType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", WIDE_SLICE_BYTES):
                langs, score = score_texts(model, batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, type=pa.string()), pa.array(score)], names=[*batch.schema.names, pred, scored])

    return docs.mapInArrow(step, out)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))
