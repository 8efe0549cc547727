"""A window's distribution against those of earlier cycles at the same time on the clock.

Each histogram row finds its cycles by local time, and a cycle's histogram is one aggregation. All compared histograms share
edges found by a sweep over sorted edges. Cycles are compared by the share above one such edge, on logits, where their
spread is that of a normal cycle; errors of leaving one cycle out come from sums less the own part. Cycles that do not
belong are found by a forward search: the clean subset is a run of the sorted levels and grows at its ends, round by round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.kernels.tails import t_isf

#: Schemes in the order of preference: days back a cycle, and how many cycles.
SCHEMES = {"1d": (1, 7), "1w": (7, 4)}
# Cycles and share of a window's columns that are needed, gain of a more specific scheme, level of the test,
# levels of the forward search's steps by the number of cycles.
LEAST_CYCLES, LEAST_COVERAGE, GAIN, ALPHA = 3, 0.5, 0.95, 0.01
FORWARD = {4: 0.00248, 5: 0.00182, 6: 0.00095, 7: 0.000937, 8: 0.000865}
#: The share above the edge that is looked for.
SHARE = 0.1


def moved(ts_ms: Column, days: Column, zone: str) -> Column:
    """The same time on the clock so many days later; null where clocks skip it."""
    wanted = F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone) + F.make_dt_interval(days)
    back = F.to_utc_timestamp(wanted, zone)
    return F.when(F.from_utc_timestamp(back, zone) == wanted, F.unix_millis(back))


def cycle_hists(rows: DataFrame, keys: list[str], start: int, end: int, step: int, zone: str = "UTC", schemes: dict[str, tuple[int, int]] = SCHEMES) -> DataFrame:
    """(keys, scheme, j, bucket_lo, bucket_hi, count, coverage): the histogram of the window (start, end] (j = 0, under each
    scheme) and of the same window j cycles before. coverage is the share of the window's columns that hold anything. rows:
    distribution rows (keys, ts_ms, bucket_lo, bucket_hi, count), ts_ms the end of a column of so many milliseconds."""
    offers = [F.struct(F.lit(name).alias("scheme"), F.lit(j).alias("j"), F.lit(j * days).alias("days")) for name, (days, k) in schemes.items() for j in range(k + 1)]
    back = max(days * k for days, k in schemes.values()) + 1
    near = rows.filter((F.col("ts_ms") > start - back * 86_400_000) & (F.col("ts_ms") <= end))
    dealt = near.withColumn("o", F.explode(F.array(*offers))).select(*keys, "ts_ms", "bucket_lo", "bucket_hi", "count", "o.*")
    at = moved(F.col("ts_ms"), F.col("days"), zone)
    dealt = dealt.withColumn("at", at).filter((F.col("at") > start) & (F.col("at") <= end))
    group = [*keys, "scheme", "j"]
    seen = dealt.groupBy(*group).agg((F.count_distinct("at") / ((end - start) / step)).alias("coverage"))
    return dealt.groupBy(*group, "bucket_lo", "bucket_hi").agg(F.sum("count").alias("count")).join(seen, group)


def common_edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edge): the finite edges at which every histogram of a group splits exactly. Along the sorted edges, the
    farthest reach of the buckets begun so far tells whether one holds the edge inside: a sweep, not a join."""
    inf = float("inf")
    buckets = rows.select(*keys, "bucket_lo", "bucket_hi").distinct()
    edges = buckets.select(*keys, F.explode(F.array("bucket_lo", "bucket_hi")).alias("at")).filter((F.col("at") > -inf) & (F.col("at") < inf)).distinct()
    points = edges.select(*keys, "at", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("reach")).unionByName(buckets.select(*keys, F.col("bucket_lo").alias("at"), F.lit(1).alias("kind"), F.col("bucket_hi").alias("reach")))
    before = F.max("reach").over(Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1))
    swept = points.withColumn("reach", before).filter("kind = 0")
    return swept.filter(F.col("reach").isNull() | (F.col("reach") <= F.col("at"))).select(*keys, F.col("at").alias("edge"))


def thresholds(hists: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """(keys, scheme, x): of the edges common to the window and its cycles, the one whose share above in the window itself
    comes nearest to share, the smaller of two as near."""
    group = [*keys, "scheme"]
    edges = common_edges(hists, group)
    now = hists.filter("j = 0").groupBy(*group, "bucket_lo").agg(F.sum("count").alias("count"))
    # Counts and edges in one order: what lies above an edge is all less what begins below it.
    points = edges.select(*group, F.col("edge").alias("at"), F.lit(0).alias("kind"), F.lit(0.0).alias("count")).unionByName(now.select(*group, F.col("bucket_lo").alias("at"), F.lit(1).alias("kind"), "count"))
    below = F.sum("count").over(Window.partitionBy(*group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("count").over(Window.partitionBy(*group))
    judged = points.withColumn("above", F.try_divide(whole - F.coalesce(below, F.lit(0.0)), whole)).filter("kind = 0")
    return judged.groupBy(*group).agg(F.min_by("at", F.struct(F.round(F.abs(F.col("above") - share), 9), "at")).alias("x"))


def shares(hists: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scheme, j, x, n, over, coverage, l, v): counts above the edge, their logit and its binomial variance, with half
    an observation more on either side."""
    group = [*keys, "scheme"]
    counted = hists.join(x, group).groupBy(*group, "j", "x").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("bucket_lo") >= F.col("x"), F.col("count")).otherwise(0.0)).alias("over"), F.max("coverage").alias("coverage"))
    p = (F.col("over") + 0.5) / (F.col("n") + 1)
    return counted.withColumn("l", F.log(p / (1 - p))).withColumn("v", 1 / ((F.col("n") + 1) * p * (1 - p)))


def _limit(k: Column, m: Column) -> Column:
    """The forward search's limit by the number of cycles and the size of the subset: fixed by FORWARD."""
    table = F.array(*[F.array(*[F.lit(t_isf(FORWARD[n] / 2, df)) if n in FORWARD else F.lit(math.inf) for df in range(1, 9)]) for n in range(9)])
    return F.get(F.get(table, k.cast("int")), (m - 2).cast("int"))


def kept_cycles(levels: DataFrame, keys: list[str], value: str, floor: Column) -> DataFrame:
    """(keys, low, high): the range of the levels of cycles that belong together. The subset of k - 2 levels (k - 1 of up to
    five) that vary least is a run of the sorted ones; the nearest outsider joins while it fits a prediction interval of the
    subset, whose deviation is floor at least. A run grows at its ends alone, so each round is one join of its ends with the
    levels and one aggregation. Up to three cycles all belong. levels: (keys, value), floor an aggregate."""
    sizes = levels.groupBy(*keys).agg(F.count("*").alias("__k"), floor.alias("floor"))
    ranked = levels.select(*keys, F.col(value).alias("l"), (F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).alias("r"))
    h = F.col("__k") - F.when(F.col("__k") <= 5, 1).otherwise(2)
    runs = ranked.join(sizes.filter(F.col("__k") > LEAST_CYCLES), keys).withColumn("h", h).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - F.col("h"))))
    runs = runs.filter((F.col("r") >= F.col("i")) & (F.col("r") < F.col("i") + F.col("h"))).groupBy(*keys, "__k", "floor", "h", "i").agg(F.var_samp("l").alias("var"))
    first = runs.groupBy(*keys, "__k", "floor", "h").agg(F.min_by("i", F.struct("var", "i")).alias("a"))
    state = first.select(*keys, "__k", "floor", "a", (F.col("a") + F.col("h") - 1).alias("b"), F.lit(True).alias("open"))
    few = sizes.filter(F.col("__k") <= LEAST_CYCLES).select(*keys, "__k", "floor", F.lit(0).cast("long").alias("a"), (F.col("__k") - 1).alias("b"), F.lit(False).alias("open"))
    state = state.unionByName(few)
    for _ in range(2):
        inside = F.when((F.col("r") >= F.col("a")) & (F.col("r") <= F.col("b")), F.col("l"))
        end = lambda i: F.max(F.when(F.col("r") == i, F.col("l")))
        at = ranked.join(state, keys).groupBy(*keys, "__k", "floor", "a", "b", "open").agg(F.avg(inside).alias("mean"), F.stddev_samp(inside).alias("dev"), end(F.col("a") - 1).alias("below"), end(F.col("b") + 1).alias("above"))
        m = F.col("b") - F.col("a") + 1
        wide = F.greatest("dev", "floor") * F.sqrt(1 + 1 / m)
        far = lambda c: F.when(F.col(c).isNull(), math.inf).when(wide > 0, F.abs(F.col(c) - F.col("mean")) / wide).otherwise(0.0)
        at = at.withColumn("left", far("below")).withColumn("right", far("above")).withColumn("limit", _limit(F.col("__k"), m))
        grows = F.col("open") & (m < F.col("__k")) & (F.least("left", "right") <= F.col("limit"))
        by_left = F.col("left") <= F.col("right")
        state = at.select(*keys, "__k", "floor", F.when(grows & by_left, F.col("a") - 1).otherwise(F.col("a")).alias("a"), F.when(grows & ~by_left, F.col("b") + 1).otherwise(F.col("b")).alias("b"), grows.alias("open"))
    met = ranked.join(state, keys)
    return met.groupBy(*keys).agg(F.max(F.when(F.col("r") == F.col("a"), F.col("l"))).alias("low"), F.max(F.when(F.col("r") == F.col("b"), F.col("l"))).alias("high"))


def compare(hists: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """(keys, scheme, x, cycles, kept, score, share, normal_lo, normal_hi, verdict): the window's share above the edge
    against a normal cycle's, under each scheme. score is the mean error of foretelling a cycle by the mean of the others,
    before any is left out; the 99 % interval is of a new cycle, from the spread of those kept (never below their own
    sampling noise) and the window's own noise."""
    group = [*keys, "scheme"]
    cells = shares(hists, thresholds(hists, keys, share), keys)
    usable = cells.filter((F.col("j") > 0) & (F.col("n") > 0) & (F.col("coverage") >= LEAST_COVERAGE))
    sums = usable.groupBy(*group).agg(F.count("*").alias("cycles"), F.sum("l").alias("sl"))
    error = F.abs(F.col("l") - F.try_divide(F.col("sl") - F.col("l"), F.col("cycles") - 1))
    scores = usable.join(sums, group).groupBy(*group, "cycles").agg(F.avg(error).alias("score"))
    kept = usable.join(kept_cycles(usable, group, "l", F.sqrt(F.avg("v"))), group).filter((F.col("l") >= F.col("low")) & (F.col("l") <= F.col("high")))
    normal = kept.groupBy(*group).agg(F.count("*").alias("kept"), F.avg("l").alias("m"), F.var_samp("l").alias("var_l"), F.avg("v").alias("mean_v"))
    now = cells.filter("j = 0").select(*group, "x", "n", "over", F.col("l").alias("l0"), F.col("v").alias("v0"))
    found = now.join(scores, group, "left").join(normal, group, "left")
    spread = F.sqrt(F.greatest("var_l", "mean_v") * (1 + 1 / F.col("kept")) + F.greatest(F.lit(0.0), F.col("v0") - F.col("mean_v")))
    wide = F.get(F.array(*[F.lit(t_isf(ALPHA / 2, df)) for df in range(1, 9)]), F.col("kept").cast("int") - 2) * spread
    enough = (F.coalesce("cycles", F.lit(0)) >= LEAST_CYCLES) & (F.col("n") > 0)
    expit = lambda z: 1 / (1 + F.exp(-z))
    outside = F.when(F.col("l0") > F.col("m") + wide, "unusual_high").when(F.col("l0") < F.col("m") - wide, "unusual_low").otherwise("usual")
    return found.select(
        *group,
        "x",
        F.coalesce("cycles", F.lit(0)).alias("cycles"),
        F.when(enough, F.col("kept")).alias("kept"),
        F.when(enough, F.col("score")).alias("score"),
        F.try_divide(F.col("over"), F.col("n")).alias("share"),
        F.when(enough, expit(F.col("m") - wide)).alias("normal_lo"),
        F.when(enough, expit(F.col("m") + wide)).alias("normal_hi"),
        F.when(enough, outside).otherwise("insufficient_history").alias("verdict"),
    )


def choose(compared: DataFrame, keys: list[str], schemes: dict[str, tuple[int, int]] = SCHEMES) -> DataFrame:
    """(keys, scheme): the reference of each series: the first scheme with a score, unless a later one is better by GAIN."""
    held = compared.filter("score IS NOT NULL").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("scheme", "score"))).alias("scores"))  # one a scheme
    picked = F.lit(None).cast("string")
    for name in schemes:
        own = F.try_element_at("scores", F.lit(name))
        first = picked.isNull() & own.isNotNull()
        better = own < F.try_element_at("scores", picked) * GAIN
        picked = F.when(first | F.coalesce(better, F.lit(False)), name).otherwise(picked)
    return held.select(*keys, picked.alias("scheme"))
