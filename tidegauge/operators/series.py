"""Statistics of series by built-in aggregates and windows; none interpolates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.quantiles import quantiles
from tidegauge.functions.timegrid import bucket_end
from tidegauge.operators.ranges import pairs


def ar1(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Lag-1 coefficient through the origin, from neighbours one step apart, clipped to 0.99."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    x = F.col("avg") - F.avg("avg").over(Window.partitionBy(*keys))
    rows = rows.withColumn("x", x)
    rows = rows.withColumn("p", F.lag("x").over(order)).withColumn("d", F.col("ts_ms") - F.lag("ts_ms").over(order)).filter(F.col("d") == step)
    phi = F.try_divide(F.sum(F.col("x") * F.col("p")), F.sum(F.col("p") * F.col("p")))
    return rows.groupBy(*keys).agg(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), phi)).alias("phi"), F.count("*").alias("pairs"))


def robust_sigma(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """1.4826 times the median absolute deviation."""
    mid = quantiles(rows, keys, value, {"median": 0.5}).drop("n")
    far = rows.join(mid, keys).withColumn("__far", F.abs(F.col(value) - F.col("median")))
    return mid.join(quantiles(far, keys, "__far", {"mad": 0.5}), keys).select(*keys, "median", (F.col("mad") * 1.4826).alias("sigma"))


def scan(rows: DataFrame, keys: list[str], tile: int = 3_600_000) -> DataFrame:
    """Counts that tell a counter from a gauge. Neighbours are met inside tiles and over their borders, so no task holds
    a whole series; a difference with NaN in it is neither a rise nor a fall nor none."""
    whole = F.when(~F.isnan("value"), (F.col("value") == F.floor("value")).cast("int"))
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("negatives"), F.min(whole).alias("integral"))
    total = lambda name: F.sum(F.col(name) + F.col(f"border_{name}"))
    steps = pairs(rows, keys, tile).groupBy(*keys).agg(total("rises").alias("increases"), total("resets").alias("decreases"), total("known").alias("known"))
    constants = F.col("known") - F.col("increases") - F.col("decreases")
    return own.join(steps, keys).select(*keys, "n", "negatives", "increases", "decreases", constants.alias("constants"), "integral")


def distances(rows: DataFrame, keys: list[str], tile: int = 3_600_000) -> DataFrame:
    """(keys, d): from each sample but a series' first to the one before it, met inside tiles and over their borders."""
    own = rows.select(*keys, "ts_ms", bucket_end(F.col("ts_ms"), tile).alias("tile"))
    inside = own.withColumn("d", F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*keys, "tile").orderBy("ts_ms"))).filter("d IS NOT NULL")
    ends = own.groupBy(*keys, "tile").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    borders = ends.withColumn("d", F.col("a") - F.lag("b").over(Window.partitionBy(*keys).orderBy("tile"))).filter("d IS NOT NULL")
    return inside.select(*keys, "d").unionByName(borders.select(*keys, "d"))


def spacing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median distance of samples, for series of three or more."""
    return quantiles(distances(rows, keys), keys, "d", {"spacing": 0.5}).filter("n >= 2").select(*keys, (F.col("n") + 1).alias("n"), "spacing")


def hour_of_week(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Quartiles by hour of the week, Monday 00:00 UTC being 0."""
    hour = F.pmod(F.floor(F.col("ts_ms") / 3_600_000) + 72, F.lit(168)).cast("int")
    return quantiles(rows.withColumn("hour", hour), [*keys, "hour"], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def fleet_spread(rows: DataFrame, value: str = "avg") -> DataFrame:
    """Quantiles over the members of each step: quartiles from three members, tenths from five, extremes always."""
    n, p = F.count(value), F.percentile(value, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    at = rows.groupBy("ts_ms").agg(n.alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), p.alias("p"))
    gate = lambda i, least: F.when(F.col("n") >= least, F.col("p")[i])
    return at.select("ts_ms", "n", "lo", "hi", gate(0, 5).alias("q10"), gate(1, 3).alias("q25"), F.col("p")[2].alias("q50"), gate(3, 3).alias("q75"), gate(4, 5).alias("q90"))


def rank_and_fold(rows: DataFrame, member: str, keep: int) -> DataFrame:
    """The keep series farthest from the steps' medians as they are (largest absolute distance; ties to the larger peak,
    then the name), the rest folded into one band of median, least and most."""
    mid = rows.groupBy("ts_ms").agg(F.percentile("avg", F.lit(0.5)).alias("mid"))
    far = rows.join(mid, "ts_ms").groupBy(member).agg(F.max(F.abs(F.col("avg") - F.col("mid"))).alias("far"), F.max("max").alias("peak"))
    # The named series are keep rows, so they may be broadcast; a sort with a limit needs no window over all series.
    named = far.orderBy(F.desc("far"), F.desc("peak"), member).limit(keep).select(member, F.col(member).cast("string").alias("series"))
    named = rows.join(F.broadcast(named), member, "left").withColumn("series", F.coalesce("series", F.lit("others")))
    return named.groupBy("series", "ts_ms").agg(F.percentile("avg", F.lit(0.5)).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"), F.count("*").alias("reporting"))


def lomb_scargle(rows: DataFrame, keys: list[str], periods_ms: list[int]) -> DataFrame:
    """Generalised Lomb-Scargle power (0 to 1) at given periods: moments per frequency, then the closed form. Values are
    centred on their series' mean first, so that a large level costs no digits; a constant series has power 0."""
    level = rows.groupBy(*keys).agg(F.avg("value").alias("__level"), F.min("ts_ms").alias("__t0"))
    rows = rows.join(level, keys).withColumn("value", F.col("value") - F.col("__level")).withColumn("ts_ms", F.col("ts_ms") - F.col("__t0"))
    w = F.col("ts_ms") * F.lit(2 * math.pi) / F.col("period_ms")
    dealt = rows.withColumn("period_ms", F.explode(F.array(*[F.lit(p).cast("long") for p in periods_ms]))).withColumn("c", F.cos(w)).withColumn("s", F.sin(w))
    m = lambda e: F.avg(e)
    y, c, s = F.col("value"), F.col("c"), F.col("s")
    a = dealt.groupBy(*keys, "period_ms").agg(m(y).alias("y"), m(c).alias("c"), m(s).alias("s"), m(y * y).alias("yy"), m(y * c).alias("yc"), m(y * s).alias("ys"), m(c * c).alias("cc"), m(s * s).alias("ss"), m(c * s).alias("cs"))
    x = lambda p, q: F.col(p + q) - F.col(p) * F.col(q)
    d = x("c", "c") * x("s", "s") - x("c", "s") * x("c", "s")
    power = (x("s", "s") * x("y", "c") * x("y", "c") + x("c", "c") * x("y", "s") * x("y", "s") - 2 * x("c", "s") * x("y", "c") * x("y", "s"))
    share = F.coalesce(F.try_divide(power, x("y", "y") * d), F.lit(0.0))
    return a.select(*keys, "period_ms", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("power"))


def run_rules(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Western-Electric style rules on standardised values z: beyond 3; 2 of 3 beyond 2, 4 of 5 beyond 1, 8 on one side.
    A window with a gap in it tells nothing."""
    def window(k: int):
        return Window.partitionBy(*keys).orderBy("ts_ms").rangeBetween(-(k - 1) * step, 0)

    def rule(k: int, need: int, beyond: float):
        full = F.count("*").over(window(k)) == k
        side = lambda sign: F.sum((F.col("z") * sign > beyond).cast("int")).over(window(k)) >= need
        return (full & (side(1) | side(-1))).cast("int")

    return rows.select(*keys, "ts_ms", (F.abs("z") > 3).cast("int").alias("r1"), rule(3, 2, 2.0).alias("r2"), rule(5, 4, 1.0).alias("r3"), rule(8, 8, 0.0).alias("r4"))


def gaussian_lowpass(rows: DataFrame, keys: list[str], step: int, sigma_steps: int) -> DataFrame:
    """Zero-phase Gaussian mean over the samples within three sigmas; each sample is dealt to the steps it reaches."""
    reach = 3 * sigma_steps
    dealt = rows.select(*keys, "ts_ms", "avg", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k"))
    w = F.exp(-(F.col("k") * F.col("k")) / F.lit(2.0 * sigma_steps * sigma_steps))
    smooth = dealt.groupBy(*keys, (F.col("ts_ms") + F.col("k") * step).alias("ts_ms")).agg((F.sum(w * F.col("avg")) / F.sum(w)).alias("smooth"))
    return rows.select(*keys, "ts_ms").join(smooth, [*keys, "ts_ms"])


def segments(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Runs of neighbouring steps (gaps and islands)."""
    island = F.col("ts_ms") - F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ms")).cast("long") * step
    return rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end"), F.count("*").alias("n")).drop("island")
