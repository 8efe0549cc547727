"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of an Arrow batch, where the session keeps Spark's default of 10,000: texts are kilobytes, not numbers.
BATCH_ROWS = 2_000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but lies at the same path (local mode, shared
    folders). On a cluster without that, ship it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
