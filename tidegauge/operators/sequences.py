"""Sequences of a series: fills, rolling and leave-one-out medians, detectors with a state, and runs.

Detectors whose state depends on all before it (EWMA, CUSUM) fold a series' ordered points. The points of one series are
collected for that, so the caller gives buckets, not raw samples: a year of hours is 8,760 of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.spans import in_spans  # noqa: F401  part of what sequences offer

# Smoothing and limit of the EWMA, reference value and limit of the CUSUM, in standard deviations.
EWMA_LAMBDA, EWMA_L = 0.2, 3.0
CUSUM_K, CUSUM_H = 0.5, 5.0


def filled(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last known value up to each row and the next one from it on."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    back = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("filled_back", back).withColumn("filled_ahead", ahead)


def rolling_median(rows: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Centred median over width rows, null where fewer than half of them (rounded up) are known."""
    near = Window.partitionBy(*keys).orderBy("ts_ms").rowsBetween(-(width // 2), (width - 1) // 2)
    return rows.withColumn("median", F.when(F.count(value).over(near) >= math.ceil(width / 2), F.percentile(value, F.lit(0.5)).over(near)))


def loo_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Median of the other rows of the group, for each row: the sorted values are ranked once, and leaving one out moves
    the middle by at most a place. Null in a group of one."""
    order = Window.partitionBy(*group).orderBy(value)
    whole = Window.partitionBy(*group)
    ranked = rows.withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count("*").over(whole))
    m = F.col("__n") - 1  # the others; without row r, place p holds p, or p + 1 from r on
    place = lambda p: F.when(p >= F.col("__r"), p + 1).otherwise(p)
    low, high = F.floor((m + 1) / 2), F.ceil((m + 1) / 2)
    middle = ranked.groupBy(*group).agg(*[F.max(F.when(F.col("__r") == at, F.col(value))).alias(name) for name, at in _middles().items()])
    out = ranked.join(middle, group)
    pick = lambda p: F.when(p == F.floor(F.col("__n") / 2), F.col("__a")).when(p == F.floor(F.col("__n") / 2) + 1, F.col("__b")).otherwise(F.col("__c"))
    return out.withColumn("others", F.when(m > 0, (pick(place(low)) + pick(place(high))) / 2)).drop("__r", "__n", "__a", "__b", "__c")


def _middles() -> dict[str, Column]:
    half = F.floor(F.col("__n") / 2)
    return {"__a": half, "__b": half + 1, "__c": half + 2}


def _ordered(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """One array a series of (ts_ms, z, gap), gap being the number of steps missing before it."""
    gap = F.greatest(F.lit(0), (F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms"))) / step - 1)
    points = rows.select(*keys, "ts_ms", F.col("z").cast("double").alias("z"), F.coalesce(gap, F.lit(0.0)).alias("gap"))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts_ms", "z", "gap"))).alias("p"))


def ewma_signals(rows: DataFrame, keys: list[str], step: int, lam: float = EWMA_LAMBDA, limit: float = EWMA_L) -> DataFrame:
    """(keys, ts_ms) where the EWMA of z leaves its asymptotic limits; it starts anew after a signal and decays over
    missing steps, which are never filled in."""
    bar = limit * math.sqrt(lam / (2 - lam))
    zero = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<bigint>").alias("hits"))

    def fold(acc: Column, x: Column) -> Column:
        e = acc["e"] * F.pow(F.lit(1 - lam), x["gap"]) * (1 - lam) + x["z"] * lam
        hit = F.abs(e) > bar
        return F.struct(F.when(hit, 0.0).otherwise(e).alias("e"), F.when(hit, F.concat(acc["hits"], F.array(x["ts_ms"]))).otherwise(acc["hits"]).alias("hits"))

    return _ordered(rows, keys, step).select(*keys, F.explode(F.aggregate("p", zero, fold, lambda acc: acc["hits"])).alias("ts_ms"))


def cusum_signals(rows: DataFrame, keys: list[str], step: int, k: float = CUSUM_K, h: float = CUSUM_H) -> DataFrame:
    """(keys, ts_ms, up, down) where a side of the tabular CUSUM of z exceeds h; both start anew after a signal and drain
    by k for each missing step."""
    kind = "array<struct<ts_ms:bigint,up:double,down:double>>"
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(kind).alias("hits"))

    def fold(acc: Column, x: Column) -> Column:
        side = lambda name, sign: F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), acc[name] - x["gap"] * k) + x["z"] * sign - k)
        up, down = side("up", 1), side("down", -1)
        hit = (up > h) | (down > h)
        entry = F.array(F.struct(x["ts_ms"].alias("ts_ms"), up.alias("up"), down.alias("down")))
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), F.when(hit, F.concat(acc["hits"], entry)).otherwise(acc["hits"]).alias("hits"))

    return _ordered(rows, keys, step).select(*keys, F.explode(F.aggregate("p", zero, fold, lambda acc: acc["hits"])).alias("s")).select(*keys, "s.*")


def cusum_paths(rows: DataFrame, keys: list[str], step: int, k: float = CUSUM_K) -> DataFrame:
    """(keys, ts_ms, up, down): both sides at each point, without starting anew. A path is a running sum less its own
    running minimum, so two windows do."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    gap = F.coalesce(F.greatest(F.lit(0), (F.col("ts_ms") - F.lag("ts_ms").over(order)) / step - 1), F.lit(0.0))
    out = rows.withColumn("gap", gap)
    for name, sign in (("up", 1), ("down", -1)):
        # A drain never goes below zero: the minimum counts the sum both after the drain and after the point.
        out = out.withColumn("s", F.sum(F.col("z") * sign - k - F.col("gap") * k).over(order)).withColumn("low", F.least(F.col("s"), F.col("s") - (F.col("z") * sign - k), F.lit(0.0)))
        out = out.withColumn(name, F.col("s") - F.min("low").over(order))
    return out.select(*keys, "ts_ms", F.round("up", 9).alias("up"), F.round("down", 9).alias("down"))


def runs(rows: DataFrame, keys: list[str], step: int, least: int = 1) -> DataFrame:
    """(keys, start, end, n) of runs of neighbouring steps that have at least so many."""
    island = F.col("ts_ms") - F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ms")).cast("long") * step
    return rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("island")


def near_bound(rows: DataFrame, keys: list[str], step: int, value: str, bound: float, share: float = 0.9, least: int = 3) -> DataFrame:
    """Runs of at least three steps at or above nine tenths of a bound."""
    return runs(rows.filter(F.col(value) >= share * bound), keys, step, least)


def block_sums(rows: DataFrame, keys: list[str], step: int, value: str, block: int) -> DataFrame:
    """(keys, block, total) over consecutive blocks of steps from a series' first on; null unless all were observed."""
    first = F.min("ts_ms").over(Window.partitionBy(*keys))
    at = F.floor((F.col("ts_ms") - first) / (step * block))
    return rows.withColumn("block", at).groupBy(*keys, "block").agg(F.when(F.count(value) == block, F.sum(value)).alias("total"))


def cycles(rows: DataFrame, keys: list[str], value: str, shift: int, k: int) -> DataFrame:
    """Each point with the values of the same time k cycles back (null where there is none), as shift_1 .. shift_k: the
    older points are moved forward and met by their keys, one shuffle for all cycles."""
    moved = rows.select(*keys, F.explode(F.array(*[F.struct((F.col("ts_ms") + shift * j).alias("ts_ms"), F.lit(j).alias("j")) for j in range(0, k + 1)])).alias("at"), F.col(value).alias("v")).select(*keys, "at.ts_ms", "at.j", "v")
    return moved.groupBy(*keys, "ts_ms").agg(F.max(F.when(F.col("j") == 0, F.col("v"))).alias(value), F.count_if(F.col("j") == 0).alias("__own"), *[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"shift_{j}") for j in range(1, k + 1)]).filter("__own > 0").drop("__own")


def index_to(rows: DataFrame, keys: list[str], value: str, start: int, end: int) -> DataFrame:
    """Values as a percentage of the series' count-weighted mean over (start, end]; none where that is not positive."""
    inside = rows.filter((F.col("ts_ms") > start) & (F.col("ts_ms") <= end))
    base = inside.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col("count")), F.sum("count")).alias("base")).filter("base > 0")
    return rows.join(base, keys).withColumn("index", F.col(value) / F.col("base") * 100)


def fill_empty_tiles(rows: DataFrame, keys: list[str], step: int, value: str) -> DataFrame:
    """A tile in which nothing landed counts as zero where the tile before or after it has a value, else it is unknown."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    near = lambda f, sign: F.when(f("ts_ms").over(order) == F.col("ts_ms") + sign * step, f(value).over(order))
    neighbour = F.coalesce(near(F.lag, -1), near(F.lead, 1))
    return rows.withColumn("filled", F.when(F.col(value).isNull() & neighbour.isNotNull(), 0.0).otherwise(F.col(value)))


def born(rows: DataFrame, keys: list[str], identity: list[str], grid: DataFrame) -> DataFrame:
    """Counts of series that are born late or die early, filled with zero where they were not yet or no longer there but
    a sibling (another series of the same identity) reported; rows: (keys, ts_ms, value), grid: (ts_ms). A series' own
    lifetime is left as it is: what is missing inside is unknown."""
    life = rows.groupBy(*keys).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    alive = rows.groupBy(*identity, "ts_ms").agg(F.count("*").alias("reporting"))
    outside = life.join(alive, identity).filter((F.col("ts_ms") < F.col("first")) | (F.col("ts_ms") > F.col("last")))
    zeros = outside.join(grid, "ts_ms", "left_semi").select(*keys, "ts_ms", F.lit(0.0).alias("value"), F.lit(True).alias("filled"))
    return rows.select(*keys, "ts_ms", "value", F.lit(False).alias("filled")).unionByName(zeros)


def sibling_counts(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Each row with the sum of the other rows of its identity and time."""
    whole = Window.partitionBy(*identity, "ts_ms")
    return rows.withColumn("siblings", F.sum("value").over(whole) - F.col("value"))


def ratio(numerator: DataFrame, denominator: DataFrame, keys: list[str]) -> DataFrame:
    """numerator / denominator on the denominator's times: what the numerator lacks is zero, a zero denominator null."""
    joined = denominator.withColumnRenamed("value", "whole").join(numerator.withColumnRenamed("value", "part"), [*keys, "ts_ms"], "left")
    return joined.select(*keys, "ts_ms", F.try_divide(F.coalesce("part", F.lit(0.0)), F.col("whole")).alias("value"))
