"""Bucket datasets: rollup of samples, and merging of buckets by the kind of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import ieee
from tidegauge.functions.timegrid import bucket_end


def rollup(samples: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, ts_ms, avg, min, max, count of each bucket."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return samples.groupBy(*keys, bucket_end(F.col("ts_ms"), step).alias("ts_ms")).agg(F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def rebucket(buckets: DataFrame, keys: list[str], step: int, kind: str) -> DataFrame:
    """Merge to a coarser step. kind: sample_mean weighs by count, time_mean and sum weigh each bucket alike (a sum stays
    per fine step), max and min take the envelope's extreme. The envelope is kept, and is null where a member with a
    value has none; a count is unknown if any member's is, and then a sample mean is the plain mean. NaN members are
    left out, but what has no other member stays NaN."""
    value = _known(F.col("avg"))
    weight = F.when(value.isNotNull(), F.col("count"))
    unknown = F.max(F.col("count").isNull().cast("int")) == 1
    had_nan = F.max((F.isnan("avg") | F.isnan("min") | F.isnan("max")).cast("int")) == 1
    or_nan = lambda x: F.when(x.isNull() & had_nan, ieee.NAN).otherwise(x)
    avg = {
        "sample_mean": F.when(unknown, F.avg(value)).otherwise(F.try_divide(F.sum(value * weight), F.sum(weight))),
        "time_mean": F.avg(value),
        "sum": F.avg(value),
        "max": F.max(_known(F.col("max"))),
        "min": F.min(_known(F.col("min"))),
    }[kind]
    torn = lambda c: F.max((value.isNotNull() & _known(F.col(c)).isNull()).cast("int")) == 1
    return buckets.groupBy(*keys, bucket_end(F.col("ts_ms"), step).alias("ts_ms")).agg(
        or_nan(avg).alias("avg"),
        F.when(~torn("min"), or_nan(F.min(_known(F.col("min"))))).alias("min"),
        F.when(~torn("max"), or_nan(F.max(_known(F.col("max"))))).alias("max"),
        F.when(~unknown, F.sum("count")).alias("count"),
    )


# Statistic kinds that may be merged by each operation.
MERGEABLE = {"sample_mean": {"avg"}, "time_mean": {"avg"}, "sum": {"sum", "avg"}, "max": {"max"}, "min": {"min"}, "count": {"sum"}}


def check_mergeable(kind: str, op: str) -> None:
    """Refuse an aggregate that a statistic does not bear: percentiles and ratios with any, others by MERGEABLE."""
    if op not in MERGEABLE.get(kind, set()):
        raise ValueError(f"{op} of {kind} values is not defined: merge the underlying counts or distributions instead")
