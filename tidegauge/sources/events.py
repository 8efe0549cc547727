"""The driver's tables as facts of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples: labels event_type and instance, ts_ms, value; event_id breaks ties in time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_type", (F.col("user_id") % 10).alias("instance"), ms.alias("ts_ms"), "value", "event_id")


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series an event_type, at most one sample a millisecond."""
    return samples(spark, sf_dir).groupBy("event_type", "ts_ms").agg(F.max("value").alias("value"))


def counter(spark: SparkSession, sf_dir: str, wrap: int = 40) -> DataFrame:
    """A counter an event_type: the number of samples so far, starting anew each wrap samples."""
    order = Window.partitionBy("event_type").orderBy("ts_ms")
    return gauge(spark, sf_dir).withColumn("value", (F.row_number().over(order) % wrap).cast("double"))


def buckets(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    from tidegauge.operators.buckets import rollup

    return rollup(samples(spark, sf_dir), ["event_type"], step)
