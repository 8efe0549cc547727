"""Summaries of series and datasets: order statistics, verdicts, gates, pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.quantiles import quantiles


def range_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, least, 0.5th, 25th, 50th, 75th and 99.5th percentile, greatest, median absolute deviation."""
    p = {"least": 0.0, "p005": 0.005, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p995": 0.995, "greatest": 1.0}
    first = quantiles(rows, keys, value, p)
    far = rows.join(first.select(*keys, "p50"), keys).withColumn("__far", F.abs(F.col(value) - F.col("p50")))
    return first.join(quantiles(far, keys, "__far", {"mad": 0.5}).drop("n"), keys).select(*keys, "n", *p, "mad")


def value_stats(rows: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """Least and greatest over several columns together; null for fewer than least values."""
    stacked = rows.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    return stacked.agg(F.count("v").alias("n"), *[F.when(F.count("v") >= least, f("v")).alias(a) for a, f in (("low", F.min), ("high", F.max))])


def characteristic_range(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1st, 50th and 99th percentile, and 95 % intervals of each from order statistics: the ranks a normal approximation
    of the binomial gives. Values are counted first; ranks are found on the running counts of distinct ones."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).join(counts.groupBy(*keys).agg(F.sum("c").alias("n")), keys)
    value_at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))

    def rank(q: float, sign: int) -> Column:
        at = F.col("n") * q + sign * 1.959963984540054 * F.sqrt(F.col("n") * (q * (1 - q)))
        return F.greatest(F.lit(1), F.least(F.col("n"), (F.floor(at) if sign < 0 else F.ceil(at) + 1)))

    aggs = []
    for name, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99)):
        h = (F.col("n") - 1) * F.lit(q)
        low, high = value_at(F.floor(h) + 1), value_at(F.ceil(h) + 1)
        aggs += [(low + (high - low) * F.max(h - F.floor(h))).alias(name), value_at(rank(q, -1)).alias(f"{name}_lo"), value_at(rank(q, 1)).alias(f"{name}_hi")]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def kind_of(scanned: DataFrame) -> DataFrame:
    """scan() rows with a verdict: a counter never falls but to start anew and does grow; constant; else a gauge."""
    falls = F.col("decreases") / F.greatest(F.col("increases") + F.col("decreases"), F.lit(1))
    verdict = F.when((F.col("increases") == 0) & (F.col("decreases") == 0), "constant").when((F.col("negatives") == 0) & (F.col("increases") > 0) & (falls <= 0.05), "counter").otherwise("gauge")
    return scanned.withColumn("verdict", verdict)


def pool_kinds(judged: DataFrame) -> DataFrame:
    """One verdict for all series of a metric: what all that are not constant agree on, else undetermined."""
    voted = judged.agg(F.count("*").alias("series"), F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("verdict") != "constant", F.col("verdict")))).alias("v"))
    return voted.select("series", "n", F.when(F.size("v") == 0, "constant").when(F.size("v") == 1, F.col("v")[0]).otherwise("undetermined").alias("verdict"))


def dataset_summary(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """One row a series of buckets: extent, buckets, coverage of the extent, mean, least, greatest, last."""
    found = rows.groupBy(*keys).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count("avg").alias("buckets"), F.avg("avg").alias("mean"), F.min("min").alias("low"), F.max("max").alias("high"), F.max_by("avg", "ts_ms").alias("latest"), F.sum("count").alias("samples"))
    return found.withColumn("coverage", F.col("buckets") / ((F.col("last") - F.col("first")) / step + 1))


def attach_counts(values: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """values with n, the number of observations behind each; a value without a count has 0 of them."""
    return values.join(counts.select(*keys, "ts_ms", "n"), [*keys, "ts_ms"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def min_samples(q: float) -> int:
    """Observations that a quantile needs: ten in its tail."""
    if not 0 < q < 1:
        raise ValueError("a quantile lies between 0 and 1")
    return math.ceil(round(10 / (1 - q), 9))


def missing_bounds(rows: DataFrame, members: int, value: str, qs: tuple[float, ...]) -> DataFrame:
    """Bounds of each step's quantiles over members when those that do not report might be anything: at -Inf for the lower
    bound and at +Inf for the upper one. The sorted values of a step are indexed, never filled up."""
    at = rows.groupBy("ts_ms").agg(F.array_sort(F.collect_list(value)).alias("v"))
    gone = F.lit(members) - F.size("v")

    def place(i: Column) -> Column:
        return F.when(i < 0, float("-inf")).when(i >= F.size("v"), float("inf")).otherwise(F.get("v", i.cast("int")))

    def bound(q: float, shift: Column) -> Column:
        h = F.lit((members - 1) * q)
        low, share = F.floor(h), F.lit((members - 1) * q - math.floor((members - 1) * q))
        a, b = place(low - shift), place(low + 1 - shift)
        return F.when((share == 0) | (a == b), a).otherwise(a + (b - a) * share)

    out = [x for q in qs for x in (bound(q, gone).alias(f"lo_{round(q * 100)}"), bound(q, F.lit(0)).alias(f"hi_{round(q * 100)}"))]
    return at.select("ts_ms", F.size("v").alias("reporting"), *out)


def coverage_verdict(states: DataFrame, keys: list[str], enough: float = 0.9) -> DataFrame:
    """Have the buckets of a claim's window been seen? enough, thin or none, by observed against expected."""
    found = states.groupBy(*keys).agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"), F.count_if(F.col("state") == 4).alias("unknown"), F.count("*").alias("buckets"))
    share = F.try_divide(F.col("observed"), F.col("expected"))
    return found.withColumn("share", share).withColumn("verdict", F.when(share.isNull() | (share == 0), "none").when((share >= enough) & (F.col("unknown") == 0), "enough").otherwise("thin"))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page number (from 0) of at most 100 rows."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    return rows.orderBy(*order).offset(size * number).limit(size)


def ordered_unique(rows: DataFrame, keys: list[str], order: str, items: str) -> DataFrame:
    """Lists of a group joined in order, each item once, where it comes first."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, items))), lambda x: x[items]))
    return rows.groupBy(*keys).agg(F.array_distinct(joined).alias(items))
