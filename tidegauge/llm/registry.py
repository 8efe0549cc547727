"""Registered queries of the training-data operators, and their oracles where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.bpe import op10_byte_bpe
from tidegauge.llm.divergence import ORACLE as DIVERGENCE_ORACLE
from tidegauge.llm.divergence import op12_source_divergence
from tidegauge.llm.fingerprints import ORACLE as FINGERPRINT_ORACLE
from tidegauge.llm.fingerprints import op8_fingerprints
from tidegauge.llm.grace_dedup import ORACLE as GRACE_ORACLE
from tidegauge.llm.grace_dedup import op11_grace_dedup
from tidegauge.llm.hard_negatives import ORACLE as NEGATIVES_ORACLE
from tidegauge.llm.hard_negatives import op13_hard_negatives
from tidegauge.llm.language import op1_language_id
from tidegauge.llm.minhash import ORACLE as MINHASH_ORACLE
from tidegauge.llm.minhash import op3_minhash_dedup
from tidegauge.llm.multi_index import ORACLE as SEARCH_ORACLE
from tidegauge.llm.multi_index import op4_multi_index
from tidegauge.llm.packing import op6_packing
from tidegauge.llm.pii import op7_pii
from tidegauge.llm.quality import op9_quality
from tidegauge.llm.sharding import ORACLE as SHARDING_ORACLE
from tidegauge.llm.sharding import op2_sharding
from tidegauge.llm.token_files import op5_token_files
from tidegauge.session import make_importable

Query = Callable[[SparkSession, str], DataFrame]

_ALL: tuple[Query, ...] = (
    op1_language_id,
    op2_sharding,
    op3_minhash_dedup,
    op4_multi_index,
    op5_token_files,
    op6_packing,
    op7_pii,
    op8_fingerprints,
    op9_quality,
    op10_byte_bpe,
    op11_grace_dedup,
    op12_source_divergence,
    op13_hard_negatives,
)
_ORACLES: dict[str, str | None] = {
    "op2_sharding": SHARDING_ORACLE,
    "op3_minhash_dedup": MINHASH_ORACLE,
    "op4_multi_index": SEARCH_ORACLE,
    "op8_fingerprints": FINGERPRINT_ORACLE,
    "op11_grace_dedup": GRACE_ORACLE,
    "op12_source_divergence": DIVERGENCE_ORACLE,
    "op13_hard_negatives": NEGATIVES_ORACLE,
}


def _importable(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        make_importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _importable(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in _ORACLES.items() if sql}
