"""Aggregation forms over document tables (buckets [end - step, end)), and concurrency from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import bucket_end_left_closed


def form(docs: DataFrame, by: list[str], step: int, **aggs: Column) -> DataFrame:
    return docs.groupBy(*by, bucket_end_left_closed(F.col("ts_ms"), step).alias("ts_ms")).agg(*[a.alias(n) for n, a in aggs.items()])


def value_histogram(docs: DataFrame, step: int, width: float, offset: float = 0.0) -> DataFrame:
    """Documents per value bucket [lo, lo + width) and time bucket."""
    lo = F.floor((F.col("value") - offset) / width) * width + offset
    return docs.groupBy(bucket_end_left_closed(F.col("ts_ms"), step).alias("ts_ms"), lo.alias("bucket_lo")).agg(F.count("*").alias("count"))


def ranges(docs: DataFrame, step: int, edges: list[float]) -> DataFrame:
    """Documents per range between edges, open at both ends; bucket_lo is null in the lowest."""
    lo = F.lit(None).cast("double")
    for e in edges:
        lo = F.when(F.col("value") >= e, F.lit(float(e))).otherwise(lo)
    return docs.groupBy(bucket_end_left_closed(F.col("ts_ms"), step).alias("ts_ms"), lo.alias("bucket_lo")).agg(F.count("*").alias("count"))


def interior_zero_fill(rates: DataFrame, by: list[str], step: int) -> DataFrame:
    """Zero for the empty buckets between a series' first and last ones, and nothing outside."""
    ends = rates.groupBy(*by).agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    grid = ends.select(*by, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("ts_ms"))
    return grid.join(rates, [*by, "ts_ms"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def refuse_above(df: DataFrame, limit: int, what: str) -> DataFrame:
    """Limits refuse, they never truncate."""
    n = df.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} {what}")
    return df


def in_flight(spans: DataFrame, by: list[str], step: int) -> DataFrame:
    """Time-averaged, least and most concurrency per bucket of spans [start_ms, end_ms). Each bucket sums the changes in
    it first; a window over buckets, not over events, carries the level in; inside a bucket the events give the
    integral and the extremes, the level that comes in included."""
    ends = F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("d")))
    events = spans.filter("end_ms > start_ms").select(*by, F.explode(ends).alias("e")).groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    events = events.withColumn("ts_ms", bucket_end_left_closed(F.col("at"), step))
    inside = Window.partitionBy(*by, "ts_ms").orderBy("at")
    events = events.withColumn("run", F.sum("d").over(inside)).withColumn("until", F.coalesce(F.lead("at").over(inside), F.col("ts_ms")))
    first = F.min("at") > F.max("ts_ms") - step  # the level that comes in lasts for some time
    tiles = events.groupBy(*by, "ts_ms").agg(
        F.sum("d").alias("net"), F.sum(F.col("run") * (F.col("until") - F.col("at"))).alias("area"),
        F.least(F.min("run"), F.when(first, 0)).alias("lo"), F.greatest(F.max("run"), F.when(first, 0)).alias("hi"),
    )
    order = Window.partitionBy(*by).orderBy("ts_ms")
    tiles = tiles.withColumn("level", F.coalesce(F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tiles = tiles.withColumn("after", F.col("level") + F.col("net")).withColumn("next", F.lead("ts_ms").over(order))
    own = tiles.select(*by, "ts_ms", (F.col("level") + F.col("area") / step).alias("avg"), (F.col("level") + F.col("lo")).alias("min"), (F.col("level") + F.col("hi")).alias("max"))
    # Buckets without an event hold the level that the one before them left, if there is any.
    still = tiles.filter((F.col("after") > 0) & (F.col("next") > F.col("ts_ms") + step))
    still = still.select(*by, F.explode(F.sequence(F.col("ts_ms") + step, F.col("next") - step, F.lit(step).cast("long"))).alias("ts_ms"), F.col("after").cast("double").alias("avg"), F.col("after").alias("min"), F.col("after").alias("max"))
    return own.unionByName(still)
