"""Exact linear (type 7) quantiles of groups of any size: rows are counted by distinct value first, and the ranks are found
by a running sum over these counts, which streams. No task holds a group's values as an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], count: str = "n", weibull: bool = False) -> DataFrame:
    """(keys, count, one column for each wanted quantile) of what is neither null nor NaN in value; groups without such
    a value have no row. wanted: name -> q between 0 and 1. weibull: by ranks of n + 1 (type 6), no farther than the ends."""
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    by = keys or ["__all"]
    known = known if keys else known.withColumn("__all", F.lit(0))
    counts = known.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__upto", upto).join(sizes, by)
    aggregates = []
    for name, q in wanted.items():
        h = F.greatest(F.lit(0.0), F.least(F.col("__n") - 1.0, (F.col("__n") + 1) * F.lit(q) - 1)) if weibull else (F.col("__n") - 1) * F.lit(q)
        low = F.min(F.when(F.col("__upto") > F.floor(h), F.col("__v")))
        high = F.min(F.when(F.col("__upto") > F.ceil(h), F.col("__v")))
        share = F.max(h - F.floor(h))
        aggregates.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return placed.groupBy(*by).agg(F.max("__n").alias(count), *aggregates).select(*keys, count, *wanted)
