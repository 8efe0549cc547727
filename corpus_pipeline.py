"""A training-corpus pipeline over documents: language, quality, near duplicates, privacy, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import language, minhash, packing, pii, quality
from tidegauge.llm.common import cut_lineage, fresh_names, fresh_path, table
from tidegauge.session import make_importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: texts that are null or have no letter, and those whose best
    language scores below MIN_SCORE. A corpus without any labelled language keeps every text with a letter."""
    make_importable(spark)
    model = language.train(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model)
    pred, score = found.columns[-2:]
    return found.filter((F.col(pred) != language.UNKNOWN) & (F.col(score) >= language.MIN_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below REJECT_BELOW; without labels of both kinds none goes."""
    make_importable(spark)
    found = quality.predict(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.filter(F.col(found.columns[-1]) >= quality.REJECT_BELOW).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near duplicates (five-word shingles, 0.8). Rows that
    share both doc_id and text are one document and stay or go together; of rows that share the doc_id alone, each stays
    or goes by its own text."""
    make_importable(spark)
    classes = minhash.near_duplicates(docs)
    doc_id, own = fresh_names(docs.columns, "__gone", "__text_hash")
    gone = cut_lineage(classes.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(own)).distinct())
    few = gone.count() <= minhash.MAX_BROADCAST_IDS
    same = (F.col("doc_id").cast("long") == F.col(doc_id)) & (minhash.text_hash(F.col("text")) == F.col(own))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in text by placeholders; n_chars, where there is one, follows the new text."""
    make_importable(spark)
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    make_importable(spark)
    packed = packing.pack(packing.pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Learned models and a tokeniser decide here, which SQL cannot express. tests/llm/test_pipeline.py compares each stage
#: with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
