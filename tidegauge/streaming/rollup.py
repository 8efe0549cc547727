"""Live bucket rollup: a bucket may change until it is older than the settle window, then it is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.timegrid import UNITS

SETTLE = "5 minutes"


def rollup(stream: DataFrame, keys: list[str], step_ms: int, settle: str = SETTLE) -> DataFrame:
    """keys, ts_ms, avg, min, max, count from a stream with ts and value. Spark's windows are [start, end); a sample is
    moved back by one millisecond, so that they become (start, end] and carry their end."""
    # The watermark stands on the column that the window is taken of; on the unshifted one it would be lost.
    shifted = stream.withColumn("ts", F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MILLISECOND")).withWatermark("ts", settle)
    window = F.window("ts", f"{step_ms // UNITS['s']} seconds")
    rows = shifted.groupBy(*keys, window.alias("w")).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"))
    return rows.select(*keys, F.unix_millis("w.end").alias("ts_ms"), "avg", "min", "max", "count")


def write_final(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append buckets once they are final; each file batch is processed exactly once."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
