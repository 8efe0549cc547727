"""Operating profile: does a series follow the hour of the day or of the week, and in which band does it move?

Each model's levels are medians a bucket of the local clock; models are compared by leave-one-out errors, found from ranks
and never by fitting again. Hourly means come in, so a year is 8,760 rows a series. The band comes from the residuals,
counted by value: pools merge by adding counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.quantiles import quantiles
from tidegauge.operators.discovery import local_hour
from tidegauge.operators.sequences import loo_median

HOUR = 3_600_000
#: Periods in the order of preference, and their numbers of buckets.
PERIODS = {"none": 1, "hour_of_day": 24, "hour_of_week": 168}
# Hours a bucket needs for a level, share of buckets that need one, gain of a richer model, residuals that an
# hour of the day needs for a band of its own, share of hours in the band.
LEAST_HOURS, LEAST_SHARE, GAIN, LEAST_POOL, COVERAGE = 3, 0.9, 0.98, 20, 0.9


def _place(period: Column, how: Column) -> Column:
    return F.when(period == "none", 0).when(period == "hour_of_day", how % 24).otherwise(how)


def residuals(hours: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """(keys, ts_ms, how, x, period, place, n, others, resid): each hour under each model, with the median of the other
    hours of its bucket. hours: (keys, ts_ms, x), ts_ms the end of the hour."""
    rows = hours.filter(F.col("x").isNotNull() & ~F.isnan("x")).select(*keys, "ts_ms", "x", local_hour(F.col("ts_ms") - HOUR, zone).alias("how"))
    rows = rows.withColumn("period", F.explode(F.array(*[F.lit(p) for p in PERIODS])))
    rows = rows.withColumn("place", _place(F.col("period"), F.col("how")))
    group = [*keys, "period", "place"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    rows = loo_median(rows, group, "x").join(sizes, group)
    return rows.withColumn("resid", F.when(F.col("n") >= LEAST_HOURS, F.col("x") - F.col("others")))


def choice(resid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period, scores map): the model chosen, and each eligible one's mean absolute leave-one-out error over the hours
    that all of them predict. A richer model must be better by GAIN."""
    filled = resid.groupBy(*keys, "period", "place").agg(F.max("n").alias("n")).groupBy(*keys, "period").agg(F.count_if(F.col("n") >= LEAST_HOURS).alias("full"))
    of = F.create_map(*[F.lit(v) for item in PERIODS.items() for v in item])
    able = filled.filter(F.col("full") >= F.lit(LEAST_SHARE) * of[F.col("period")]).select(*keys, "period")
    wanted = able.groupBy(*keys).agg(F.count("*").alias("models"))
    met = resid.join(able, [*keys, "period"]).filter("resid IS NOT NULL")
    # An hour counts if every eligible model has a residual for it.
    whole = met.groupBy(*keys, "ts_ms").agg(F.count("*").alias("models")).join(wanted, [*keys, "models"]).select(*keys, "ts_ms")
    scores = met.join(whole, [*keys, "ts_ms"]).groupBy(*keys, "period").agg(F.avg(F.abs("resid")).alias("score"))
    held = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("period", "score"))).alias("scores"))  # three at most
    picked = F.lit("none")
    for period in list(PERIODS)[1:]:
        better = F.col("scores")[period] < F.try_element_at("scores", picked) * GAIN
        picked = F.when(F.coalesce(better, F.lit(False)), period).otherwise(picked)
    return held.select(*keys, picked.alias("period"), "scores")


def seasonal(hours: DataFrame, keys: list[str], zone: str = "UTC") -> DataFrame:
    """(keys, period, place, n, level, lo, q25, q75, hi, pool): the buckets of each series' model. The band adds quantiles of
    the residuals to the level: of the bucket's hour of the day where every such hour has LEAST_POOL of them, else of all.
    Sparse buckets have no level. A quantile covers a new hour with the stated chance (ranks of n + 1)."""
    resid = residuals(hours, keys, zone)
    picked = choice(resid, keys).select(*keys, "period")
    mine = resid.join(picked, [*keys, "period"])
    known = mine.filter("resid IS NOT NULL").withColumn("hod", F.col("how") % 24)
    pools = known.groupBy(*keys, "period", "hod").agg(F.count("*").alias("c")).groupBy(*keys, "period").agg(F.count_if(F.col("c") >= LEAST_POOL).alias("rich"))
    by_hour = pools.select(*keys, ((F.col("rich") == 24) & (F.col("period") != "none")).alias("by_hour"))
    known = known.join(by_hour, keys).withColumn("pool", F.when(F.col("by_hour"), F.col("hod")).otherwise(-1))
    a = (1 - COVERAGE) / 2
    band = quantiles(known, [*keys, "pool"], "resid", {"lo": a, "q25": 0.25, "q75": 0.75, "hi": 1 - a}, weibull=True).drop("n")
    levels = quantiles(mine, [*keys, "period", "place"], "x", {"level": 0.5})
    levels = levels.withColumn("level", F.when(F.col("n") >= LEAST_HOURS, F.col("level")))
    levels = levels.join(by_hour, keys).withColumn("pool", F.when(F.col("by_hour"), F.col("place") % 24).otherwise(-1))
    edge = lambda c: (F.col("level") + F.col(c)).alias(c)
    return levels.join(band, [*keys, "pool"], "left").select(*keys, "period", "place", "n", "level", *[edge(c) for c in ("lo", "q25", "q75", "hi")], F.when(F.col("pool") < 0, "all").otherwise("hour_of_day").alias("pool"))


def band_at(hours: DataFrame, profile: DataFrame, keys: list[str], zone: str = "UTC") -> DataFrame:
    """hours with the level and band of their bucket, and where they lie: below, inside or above; null without a level."""
    models = profile.select(*keys, "period").distinct()
    rows = hours.join(models, keys).withColumn("place", _place(F.col("period"), local_hour(F.col("ts_ms") - HOUR, zone)))
    met = rows.join(profile.select(*keys, "period", "place", "level", "lo", "hi"), [*keys, "period", "place"], "left")
    return met.withColumn("where", F.when(F.col("x") < F.col("lo"), "below").when(F.col("x") > F.col("hi"), "above").when(F.col("level").isNotNull(), "inside"))
