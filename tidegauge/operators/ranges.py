"""Range-vector functions: one set-based plan for every grid time.

A window (t - width, t] is a run of tiles, whose size divides both the step and the width. Samples are reduced to one row
a tile first, by hash aggregation or a window inside the tile; what crosses the border between two tiles is
found by a window over tiles; then each tile, not each sample, is dealt to the windows that hold it. So no sample is
copied and no task holds a whole series' samples. Functions that need every sample of a window (quantiles, regressions)
deal the samples themselves. No range join anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import bucket_end, windows_of


def on_grid(samples: DataFrame, step: int, width: int) -> DataFrame:
    return samples.withColumn("t", F.explode(windows_of(F.col("ts_ms"), step, width)))


def over_time(samples: DataFrame, keys: list[str], step: int, width: int, **functions: Column) -> DataFrame:
    """Any aggregates of value and ts_ms over each window, from the samples themselves."""
    return on_grid(samples, step, width).groupBy(*keys, "t").agg(*[f.alias(name) for name, f in functions.items()])


#: Functions that tiles can be combined into, by name.
TILED = ("avg", "min", "max", "sum", "count", "last", "first", "present", "stddev", "stdvar")


def greatest(x: Column) -> Column:
    """Aggregate: the greatest value. Spark orders NaN above all numbers; here it counts only where nothing else is."""
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))


def falls(after: Column, before: Column) -> Column:
    """Does after lie below before? Not where either is NaN."""
    return F.coalesce((after < before) & ~F.isnan(after) & ~F.isnan(before), F.lit(False))


def known(after: Column, before: Column) -> Column:
    """Are both there and numbers?"""
    return after.isNotNull() & before.isNotNull() & ~F.isnan(after) & ~F.isnan(before)


def folded(samples: DataFrame, keys: list[str], step: int, width: int, how: str) -> DataFrame:
    """<how>_over_time for one of TILED. Variances combine by the tiles' own means, which loses no digits."""
    v, ts = F.col("value"), F.col("ts_ms")
    n, m = F.col("n"), F.col("m")
    tile, combine = {
        "avg": ({"n": F.count(v), "m": F.sum(v)}, F.sum("m") / F.sum("n")),
        "min": ({"m": F.min(v)}, F.min("m")),
        "max": ({"m": greatest(v)}, greatest(F.col("m"))),
        "sum": ({"m": F.sum(v)}, F.sum("m")),
        "count": ({"m": F.count(v)}, F.sum("m").cast("double")),
        "last": ({"m": F.max_by(v, ts)}, F.max_by("m", "tile")),
        "first": ({"m": F.min_by(v, ts)}, F.min_by("m", "tile")),
        "present": ({"m": F.max(F.lit(1.0))}, F.max("m")),
        "stddev": ({"n": F.count(v), "m": F.avg(v), "s": F.var_pop(v)}, None),
        "stdvar": ({"n": F.count(v), "m": F.avg(v), "s": F.var_pop(v)}, None),
    }[how]
    tiles = samples.groupBy(*keys, bucket_end(ts, _fine(step, width)).alias("tile")).agg(*[x.alias(name) for name, x in tile.items()])
    if combine is None:
        within = F.sum(n * F.col("s")) / F.sum(n)
        # The spread of the tiles' means, against the mean of a first tile so that no large squares cancel.
        shift = m - F.min_by("m", "tile").over(Window.partitionBy(*keys, "t"))
        spread = F.sum(n * F.col("d") * F.col("d")) / F.sum(n) - F.pow(F.sum(n * F.col("d")) / F.sum(n), 2)
        dealt = _dealt(tiles, step, width).withColumn("d", shift)
        variance = F.greatest(F.lit(0.0), within + spread)
        return dealt.groupBy(*keys, "t").agg((F.sqrt(variance) if how == "stddev" else variance).alias("value"))
    return _dealt(tiles, step, width).groupBy(*keys, "t").agg(combine.alias("value"))


def pairs(samples: DataFrame, keys: list[str], step: int) -> DataFrame:
    """One row a tile: n, first and last sample, and over neighbouring samples inside the tile what a counter lost at
    resets, the number of changes, of falls, of rises and of pairs without NaN; border_*: the same between the tile before
    and this one. Samples of one time follow each other by value."""
    rows = samples.select(*keys, "ts_ms", "value", bucket_end(F.col("ts_ms"), step).alias("tile"))
    inside = Window.partitionBy(*keys, "tile").orderBy("ts_ms", "value")
    rows = rows.withColumn("before", F.lag("value").over(inside)).withColumn("before_ts", F.lag("ts_ms").over(inside))
    v, p = F.col("value"), F.col("before")
    own = F.struct("ts_ms", "value")
    tiles = rows.groupBy(*keys, "tile").agg(
        F.count("*").alias("n"),
        F.min(own).alias("a"),
        F.max(F.struct("ts_ms", "value", "before_ts", "before")).alias("b"),
        F.sum(F.when(falls(v, p), p).otherwise(0.0)).alias("lost"),
        F.count_if(v != p).alias("changes"),
        F.count_if(falls(v, p)).alias("resets"),
        F.count_if(falls(p, v)).alias("rises"),
        F.count_if(known(v, p)).alias("known"),
    )
    tiles = tiles.withColumn("p", F.lag("b").over(Window.partitionBy(*keys).orderBy("tile")))
    v, p = F.col("a.value"), F.col("p.value")
    border = {"lost": F.when(falls(v, p), p).otherwise(0.0)}
    border |= {name: F.coalesce(x, F.lit(False)).cast("int") for name, x in (("changes", v != p), ("resets", falls(v, p)), ("rises", falls(p, v)), ("known", known(v, p)))}
    return tiles.withColumns({f"border_{name}": x for name, x in border.items()})


def _summed(name: str) -> Column:
    """Sum over a window's tiles, without the border before its first one."""
    return F.sum(F.col(name) + F.col(f"border_{name}")) - F.min_by(f"border_{name}", "tile")


def _fine(step: int, width: int) -> int:
    """A tile that both the step and the width are whole numbers of."""
    a, b = step, width
    while b:
        a, b = b, a % b
    return a


def _dealt(tiles: DataFrame, step: int, width: int) -> DataFrame:
    """Tiles of any size that divides step and width, dealt to the grid times t whose window holds them."""
    first = bucket_end(F.col("tile"), step)
    return tiles.withColumn("t", F.explode(F.when(first < F.col("tile") + width, F.sequence(first, F.col("tile") + (width - 1), F.lit(step).cast("long")))))


def extrapolated(samples: DataFrame, keys: list[str], step: int, width: int, counter: bool, per_second: bool) -> DataFrame:
    """rate (counter, per second), increase (counter) or delta (neither): the change between a window's first and last
    sample, carried to the window's edges but by half a spacing only where a sample is missing there, and for counters
    never below zero. What a counter lost at its resets is summed inside the window alone. Windows of fewer than two
    samples, or whose samples all have one time, have no value."""
    tiles = pairs(samples, keys, _fine(step, width))
    lost = _summed("lost") if counter else F.lit(0.0)
    ends = _dealt(tiles, step, width).groupBy(*keys, "t").agg(F.sum("n").alias("n"), F.min("a").alias("first"), F.max_by("b", "tile").alias("last"), lost.alias("lost")).filter("n >= 2")
    ends = ends.select(*keys, "t", "n", F.col("first.ts_ms").alias("a"), F.col("last.ts_ms").alias("b"), F.col("first.value").alias("first"), (F.col("last.value") - F.col("first.value") + F.col("lost")).alias("change"))
    ends = ends.filter("b > a").withColumn("sampled", (F.col("b") - F.col("a")) / 1000)
    spacing = F.col("sampled") / (F.col("n") - 1)
    ahead, after = (F.col("a") - (F.col("t") - width)) / 1000, (F.col("t") - F.col("b")) / 1000
    ahead = F.when(ahead >= spacing * 1.1, spacing / 2).otherwise(ahead)
    after = F.when(after >= spacing * 1.1, spacing / 2).otherwise(after)
    if counter:
        ahead = F.when((F.col("change") > 0) & (F.col("first") >= 0), F.least(ahead, F.col("sampled") * F.try_divide(F.col("first"), F.col("change")))).otherwise(ahead)
    factor = (F.col("sampled") + ahead + after) / F.col("sampled") / (width / 1000 if per_second else 1.0)
    return ends.select(*keys, "t", (F.col("change") * factor).alias("value"))


def pairwise(samples: DataFrame, keys: list[str], step: int, width: int, resets: bool) -> DataFrame:
    """changes or resets in each window."""
    name = "resets" if resets else "changes"
    return _dealt(pairs(samples, keys, _fine(step, width)), step, width).groupBy(*keys, "t").agg(_summed(name).alias("value"))


def instant(samples: DataFrame, keys: list[str], step: int, width: int, per_second: bool) -> DataFrame:
    """irate (per second, a fall counts from zero) or idelta: a window's last two samples."""
    tiles = pairs(samples, keys, _fine(step, width))
    before_ts, before = F.coalesce("b.before_ts", "p.ts_ms"), F.coalesce("b.before", "p.value")
    tiles = tiles.select(*keys, "tile", F.struct(F.col("b.ts_ms").alias("ts_ms"), F.col("b.value").alias("value"), before_ts.alias("prev_ts"), before.alias("prev")).alias("s"))
    last = _dealt(tiles, step, width).groupBy(*keys, "t").agg(F.max_by("s", "tile").alias("s")).filter(F.col("s.prev_ts") > F.col("t") - width)
    change = F.col("s.value") - F.col("s.prev")
    if per_second:
        last = last.filter(F.col("s.ts_ms") > F.col("s.prev_ts"))
        change = F.when(falls(F.col("s.value"), F.col("s.prev")), F.col("s.value")).otherwise(change) / ((F.col("s.ts_ms") - F.col("s.prev_ts")) / 1000)
    return last.select(*keys, "t", change.alias("value"))
