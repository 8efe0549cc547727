"""Catalog claims: (metric, field, origin, value, confidence, ts_ms); the winner is found on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Origins, the strongest first.
ORIGINS = ("user", "agent", "stats", "context", "pack", "metadata", "rule")


def winners(claims: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin"))
    order = Window.partitionBy("metric", "field").orderBy(rank, F.desc("confidence"), F.desc("ts_ms"), F.desc("value"))
    return claims.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def conflicts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("metric", "field").agg(F.countDistinct("value").alias("values")).filter("values > 1")
