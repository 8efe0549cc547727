"""Several quantities of one system on one time axis: aligned by role, and Little's law (L = lambda W) by window.

Roles meet in one union and one aggregation by (group, time), whatever their number; groups that lack a role are reported,
not dropped. Windows and their halves are sums of sub-steps, so a window's verdict is two aggregations, and the total over
all groups is one more. No window function, no group as an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.kernels.tails import t_isf

#: The roles of the law: arrivals a second, sum and count of times spent (in seconds), and what is inside.
ARRIVALS, SPENT, DONE, INSIDE = "arrivals", "spent", "done", "inside"
ROLES = (ARRIVALS, SPENT, DONE, INSIDE)
# Level of a window's test, and blocks that a window needs for one.
ALPHA, LEAST_BLOCKS = 0.01, 3
#: Log ratios nearer to 0 than this are no departure, even where blocks do not scatter at all.
EXACT = 1e-9


def align(roles: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, ts_ms, one column a role): every (group, time) of any role, null where a role has nothing there. Of several
    values of one role, group and time, the sum. roles: name -> (keys, ts_ms, value)."""
    tagged = [df.select(*keys, "ts_ms", F.lit(name).alias("__role"), F.col("value").cast("double").alias("value")) for name, df in roles.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy(*keys, "ts_ms").agg(*[F.sum(F.when(F.col("__role") == name, F.col("value"))).alias(name) for name in roles])


def unmatched(aligned: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """(keys, present, missing): the groups that lack a role at all times, with the roles they have and lack, in order."""
    has = aligned.groupBy(*keys).agg(*[F.count(r).alias(r) for r in roles])
    names = lambda there: F.array_join(F.filter(F.array(*[F.when((F.col(r) > 0) == F.lit(there), F.lit(r)) for r in roles]), lambda x: x.isNotNull()), ",")
    found = has.select(*keys, names(True).alias("present"), names(False).alias("missing"))
    return found.filter("missing <> ''")


def matched(aligned: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """aligned without the groups that lack a role."""
    return aligned.join(unmatched(aligned, keys, roles).select(*keys), keys, "left_anti")


def combine(aligned: DataFrame, roles: list[str]) -> DataFrame:
    """(ts_ms, roles): the total over all groups, each role over the groups that reported it."""
    return aligned.groupBy("ts_ms").agg(*[F.sum(r).alias(r) for r in roles])


def windows(aligned: DataFrame, keys: list[str], step: int, width: int, block: int, start: int) -> DataFrame:
    """Little's law in windows of width sub-steps from start on, and in windows shifted by half of that (grid 1), since an
    episode that begins and ends inside a window balances over it. A window's ratio is L / (lambda W) from its sums; its
    scatter is that of the log ratios of its blocks. Sub-steps in which nothing arrived or was done count as 0; one without
    what is inside is unknown, and a window with such a one is not judged.

    (keys, grid, window, end_ms, n, l, arrival_rate, w, ratio, blocks, scatter, low, high, verdict)"""
    rows = aligned.withColumns({r: F.coalesce(r, F.lit(0.0)) for r in (ARRIVALS, SPENT, DONE)})
    rows = rows.withColumn("at", ((F.col("ts_ms") - start) / step).cast("long") - 1).filter("at >= 0")
    rows = rows.withColumn("grid", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("at") - F.col("grid") * (width // 2)).filter("at >= 0")
    rows = rows.withColumn("window", F.floor(F.col("at") / width)).withColumn("block", F.floor(F.col("at") % width / block))
    sums = [F.count(INSIDE).alias("n"), *[F.sum(r).alias(r) for r in ROLES]]
    blocks = rows.groupBy(*keys, "grid", "window", "block").agg(*sums)
    # With equal sub-steps the means' common divisor cancels: L / (lambda W) = sum L * sum n / (sum lambda * sum w).
    law = lambda: F.try_divide(F.col(INSIDE) * F.col(DONE), F.col(ARRIVALS) * F.col(SPENT))
    blocks = blocks.withColumn("log_ratio", F.when((F.col("n") == block) & (law() > 0), F.log(law())))
    found = blocks.groupBy(*keys, "grid", "window").agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in ROLES], F.count("log_ratio").alias("blocks"), F.stddev_samp("log_ratio").alias("scatter"))
    half = F.col("scatter") / F.sqrt("blocks") * F.get(F.array(*[F.lit(t_isf(ALPHA / 2, df)) if df else F.lit(None).cast("double") for df in range(width // block + 1)]), F.col("blocks").cast("int") - 1)
    found = found.withColumn("ratio", law()).withColumn("half", F.when(F.col("blocks") >= LEAST_BLOCKS, half))
    verdict = (
        F.when(F.col("n") < width, "insufficient")
        .when(F.col(ARRIVALS) == 0, "no_traffic")
        .when(F.col("half").isNull() | F.col("ratio").isNull(), "insufficient")
        .when(F.log("ratio") > F.col("half") + EXACT, "L_high")
        .when(F.log("ratio") < -F.col("half") - EXACT, "L_low")
        .otherwise("consistent")
    )
    end = F.lit(start) + (F.col("grid") * (width // 2) + (F.col("window") + 1) * width) * step
    return found.select(
        *keys,
        "grid",
        F.col("window").cast("long").alias("window"),
        end.cast("long").alias("end_ms"),
        "n",
        F.try_divide(F.col(INSIDE), F.col("n")).alias("l"),
        (F.col(ARRIVALS) / width).alias("arrival_rate"),
        F.try_divide(F.col(SPENT), F.col(DONE)).alias("w"),
        "ratio",
        "blocks",
        "scatter",
        (F.col("ratio") * F.exp(-F.col("half"))).alias("low"),
        (F.col("ratio") * F.exp(F.col("half"))).alias("high"),
        verdict.alias("verdict"),
    )


def judged(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, windows, off, shifted_only): a group's verdict over both grids. A shifted window that is off counts
    only where no window of the main grid that overlaps it is off too: its neighbours are the window of its number and the
    one after."""
    off = F.col("verdict").isin("L_high", "L_low")
    main = found.filter((F.col("grid") == 0) & off).select(*keys, F.explode(F.array(F.col("window"), F.col("window") - 1)).alias("window")).distinct()
    extra = found.filter((F.col("grid") == 1) & off).join(main, [*keys, "window"], "left_anti").groupBy(*keys).agg(F.count("*").alias("shifted_only"))
    own = found.filter("grid = 0").groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(off).alias("off"), F.count_if(F.col("verdict") == "consistent").alias("fine"))
    own = own.join(extra, keys, "left").withColumn("shifted_only", F.coalesce("shifted_only", F.lit(0)))
    verdict = F.when(F.col("off") + F.col("shifted_only") > 0, "inconsistent_in_windows").when(F.col("fine") > 0, "consistent").otherwise("insufficient")
    return own.select(*keys, verdict.alias("verdict"), "windows", "off", "shifted_only")
