"""Bucket states by cadence: what each bucket should hold follows from the spacing of the series' own samples around it.

Non-empty buckets are looked at with the sixteen gaps before and after each (holes left out); a gap is judged by the side
that it resembles most, so either side of a change of rate reads at its own rate. Each non-empty bucket then lays out the
empty ones before it, with what it knows of their gap, so that buckets, gaps and grid stay in one partitioning by series: no
grid is joined, and all windows share one shuffle. Windows run over the buckets of a series, never over raw samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.spans import in_spans
from tidegauge.operators.state import ABSENT, EMPTY, OK, PARTIAL, POST_GAP, SUSPECT, UNKNOWN

# Flags beside POST_GAP.
RESET, INTERVAL_CHANGE, STALE_MARKER, CADENCE = 1, 2, 4, 32
# Fixed values of the rules: gaps of a neighbourhood, and how many it needs; a hole against the median gap; slower than the
# step, and the gaps over the step that show it; a slow series' miss; one sample a bucket; a shortfall; a change of rate.
NEAR, LEAST_GAPS, HOLE = 16, 2, 2.0
SLOW, LONG_GAPS, SLOW_MISS = 1.25, 2, 1.5
ABOUT_ONE = (0.8, 1.2)
SHARE, SLACK = 0.9, 0.1
CHANGE, CHANGE_BUCKETS = 2.0, 3
# Fixed values of a cadence a little slower than the step: least spacing of the buckets it skips, spacings in a row that
# show it, how far they may differ, how close the source's interval must be.
SKIP_LEAST, SKIP_RUN, SKIP_SLACK, SKIP_SPREAD, SKIP_MATCH = 4, 4, 2.0, 0.25, 0.05
BASELINE_PASSES = 2


def short(observed: Column, expected: Column) -> Column:
    """Below what is expected by more than a sample's jitter, or a tenth, and the estimate's own error."""
    return observed < expected - (F.greatest(F.lit(1.0), expected * (1 - SHARE)) + SLACK)


def _judged(nz: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Non-empty buckets with g (time since the one before), I and slow of the gap that ends here, and It and slow_t of the
    open one after."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    whole = Window.partitionBy(*keys)
    nz = nz.withColumn("prev", F.lag("ts_ms").over(order)).withColumn("g", (F.col("ts_ms") - F.col("prev")).cast("double"))
    nz = nz.withColumn("med", F.percentile("g", F.lit(0.5)).over(order.rowsBetween(-NEAR, NEAR)))
    kept = F.col("g").isNotNull() & (F.col("g") <= HOLE * F.col("med"))
    nz = nz.withColumns({"kg": F.when(kept, F.col("g")), "kc": F.when(kept, F.col("observed")), "kl": F.when(kept & (F.col("g") > step), 1)})
    sides = {"p": order.rowsBetween(-NEAR, -1), "a": order.rowsBetween(1, NEAR), "b": order.rowsBetween(1 - NEAR, 0), "w": whole}
    for side, frame in sides.items():
        g, c, n, long = F.sum("kg").over(frame), F.sum("kc").over(frame), F.count("kg").over(frame), F.count("kl").over(frame)
        interval = F.when((n >= (1 if side == "w" else LEAST_GAPS)) & (c > 0), g / c)
        nz = nz.withColumns({f"I_{side}": interval, f"L_{side}": long})
        nz = nz.withColumn(f"S_{side}", F.coalesce((F.col(f"I_{side}") > SLOW * step) & (F.col(f"L_{side}") >= LONG_GAPS), F.lit(False)))
    typical = F.percentile("observed", F.lit(0.5)).over(whole)
    plain = F.coalesce("I_w", step / F.greatest(F.lit(1.0), typical))
    own = F.col("g") / F.col("observed")
    off = lambda side: F.abs(F.log(F.col(f"I_{side}") / own))
    # A tie goes to the faster side, which reports a miss rather than hides one.
    after = F.col("I_p").isNull() | (F.col("I_a").isNotNull() & (own.isNull() | (off("a") < off("p")) | ((off("a") == off("p")) & (F.col("I_a") < F.col("I_p")))))
    none = F.col("I_p").isNull() & F.col("I_a").isNull()
    return nz.select(
        *keys,
        "ts_ms",
        "observed",
        "prev",
        "g",
        "med",
        F.when(none, plain).when(after, F.col("I_a")).otherwise(F.col("I_p")).alias("I"),
        F.when(none, F.col("S_w")).when(after, F.col("S_a")).otherwise(F.col("S_p")).alias("slow"),
        F.coalesce("I_b", plain).alias("It"),
        F.when(F.col("I_b").isNull(), F.col("S_w")).otherwise(F.col("S_b")).alias("slow_t"),
        F.lead("ts_ms").over(order).isNull().alias("is_last"),
    )


def _laid_out(judged: DataFrame, keys: list[str], step: int, start: int, end: int) -> DataFrame:
    """All buckets of (start, end]: each non-empty one with the empty ones before it, the last with those after it."""
    every = F.lit(step).cast("long")
    before = F.sequence(F.coalesce(F.col("prev") + step, F.lit(start + step).cast("long")), F.col("ts_ms"), every)
    behind = F.when(F.col("is_last") & (F.col("ts_ms") < end), F.sequence(F.col("ts_ms") + step, F.lit(end).cast("long"), every)).otherwise(F.array().cast("array<bigint>"))
    rows = judged.withColumn("t", F.explode(F.concat(before, behind)))
    here, trailing = F.col("t") == F.col("ts_ms"), F.col("t") > F.col("ts_ms")
    return rows.select(
        *keys,
        F.col("t").alias("ts_ms"),
        F.when(here, F.col("observed")).otherwise(0.0).alias("observed"),
        F.when(here, F.col("g")).alias("g"),
        F.when(here, F.col("med")).alias("med"),
        F.when(trailing, F.col("It")).otherwise(F.col("I")).alias("I"),
        F.when(trailing, F.col("slow_t")).otherwise(F.col("slow")).alias("slow"),
        F.when(trailing, F.col("ts_ms")).otherwise(F.col("prev")).alias("ref"),
        (F.col("prev").isNull() & (F.col("t") < F.col("ts_ms"))).alias("absent"),
        F.when(~trailing, F.col("ts_ms")).alias("gap_end"),
        trailing.alias("trailing"),
    )


def _spilled(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Adds spilled: an empty bucket beside one with two samples, only ones between, where about one a bucket is scraped: a
    scrape near the border fell to the other side. Empty (Z) and double (T) buckets that alternate pair off from the start
    of their run; what comes of an unknown or longer gap (X) begins anew. A T that opens a stretch has its Z out of sight; a
    last Z still waiting counts if the series was seen spilling before."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # What follows is read backwards: a frame up to the end of a series is summed anew for each of its rows.
    later = Window.partitionBy(*keys).orderBy(F.desc("ts_ms")).rowsBetween(Window.unboundedPreceding, -1)
    rate = step / F.col("I")
    one = ~F.col("slow") & (rate >= ABOUT_ONE[0]) & (rate <= ABOUT_ONE[1])
    full = (F.col("observed") > 0) & ~F.col("unk")
    zero = (F.col("observed") == 0) & ~F.col("unk") & ~F.col("absent")
    rows = rows.withColumn("full", full).withColumn("zero", zero)
    lone = F.coalesce(F.lag("full").over(order), F.lit(False)) & F.coalesce(F.lead("full").over(order), F.lit(True))
    kind = F.when(F.col("zero") & lone & one, "Z").when(F.col("full") & (F.col("observed") >= 2) & one, "T").when((F.col("zero") & ~lone) | F.col("unk"), "X")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("before", F.last("kind", ignorenulls=True).over(earlier)).withColumn("next", F.last("kind", ignorenulls=True).over(later))
    event = F.col("kind").isin("Z", "T")
    fresh = F.col("before").isNull() | (F.col("before") == "X")
    opens = F.coalesce(F.col("kind").isNotNull() & ((F.col("kind") == "X") | fresh | (F.col("before") == F.col("kind"))), F.lit(False))
    rows = rows.withColumn("run", F.sum(opens.cast("int")).over(upto)).withColumn("hidden", F.coalesce(opens & fresh & (F.col("kind") == "T"), F.lit(False)))
    run = Window.partitionBy(*keys, "run")
    skip = F.max(F.col("hidden").cast("int")).over(run)
    place = F.count(F.when(event, 1)).over(run.orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)) - skip
    n = F.count(F.when(event, 1)).over(run) - skip
    paired = event & (place >= 1) & ((place % 2 == 0) | (place < n))
    rows = rows.withColumn("paired", F.coalesce(paired, F.lit(False)))
    seen = F.coalesce(F.max((F.col("paired") | F.col("hidden")).cast("int")).over(earlier) == 1, F.lit(False))
    waits = seen & (F.col("next").isNull() | (F.col("next") == "X"))
    return rows.withColumn("spilled", F.coalesce((F.col("kind") == "Z") & (F.col("paired") | waits), F.lit(False))).drop("kind", "before", "next", "run", "hidden", "paired")


def _skips(rows: DataFrame, keys: list[str], step: int, resolution: int | None) -> DataFrame:
    """Adds cad and undet: empty buckets at the regular spacing that a cadence up to 1.25 times the step leaves. Losses that
    recur look the same; only the source's own interval tells, and without it such a bucket is undetermined."""
    order, whole = Window.partitionBy(*keys).orderBy("ts_ms"), Window.partitionBy(*keys)
    skipped = F.col("zero") & ~F.col("spilled")
    rows = rows.withColumn("skip_t", F.when(skipped, F.col("ts_ms")))
    rows = rows.withColumn("d", F.when(skipped, (F.col("ts_ms") - F.last("skip_t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))) / step))
    rows = rows.withColumn("j", F.count("skip_t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    regular = lambda low, high: (low >= SKIP_LEAST) & (high - low <= F.greatest(F.lit(SKIP_SLACK), low * SKIP_SPREAD))
    by_skip = Window.partitionBy(*keys).orderBy("j")
    last_few, next_few = by_skip.rangeBetween(1 - SKIP_RUN, 0), by_skip.rangeBetween(0, SKIP_RUN)
    run = F.col("d").isNotNull() & (F.count("d").over(last_few) == SKIP_RUN) & regular(F.min("d").over(last_few), F.max("d").over(last_few))
    rows = rows.withColumn("run_here", F.coalesce(run, F.lit(False)).cast("int"))
    n = F.count("skip_t").over(whole)
    twos = F.count(F.when(F.col("full") & (F.col("observed") >= 2), 1)).over(whole)
    steady = regular(F.percentile("d", F.lit(0.25)).over(whole), F.percentile("d", F.lit(0.75)).over(whole)) & (F.count("d").over(whole) >= SKIP_RUN) & (2 * twos <= n)
    mean = F.try_divide((F.max("skip_t").over(whole) - F.min("skip_t").over(whole)) / step, n - 1)
    missed = skipped & ~F.col("slow")
    cad = missed & F.coalesce(steady, F.lit(False)) & (F.max("run_here").over(next_few) == 1)
    interval = F.try_divide(mean * step, mean - 1)
    known = F.lit(False) if resolution is None or resolution <= step else F.coalesce(F.abs(interval / resolution - 1) <= SKIP_MATCH, F.lit(False))
    return rows.withColumn("cad", cad).withColumn("undet", F.col("cad") & ~known).drop("skip_t", "d", "j", "run_here")


def _expected(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Adds expected: by the interval where the series is slower than the step, else samples a bucket over the series' gaps,
    lost buckets' time taken out, and re-estimated without the buckets that are short of it."""
    whole = Window.partitionBy(*keys)
    lost = F.count(F.when(F.col("zero") & (F.col("missed") | F.col("undet")) & ~F.col("slow"), 1)).over(Window.partitionBy(*keys, "gap_end"))
    rows = rows.withColumn("g2", F.col("g") - step * lost)
    use = F.coalesce(F.col("full") & ~F.col("slow") & (F.col("g2") <= HOLE * F.col("med")), F.lit(False))
    least = F.when(F.max((F.col("cad") & ~F.col("undet")).cast("int")).over(whole) == 1, 1 / SLOW).otherwise(1.0)
    typical = F.percentile(F.when(F.col("full"), F.col("observed")), F.lit(0.5)).over(whole)
    rows = rows.withColumns({"use": use, "least": least, "typical": typical})
    for turn in range(BASELINE_PASSES + 1):
        counts = F.col("use") if turn == 0 else F.col("use") & ~short(F.col("observed"), F.col("fast"))
        n, t = F.sum(F.when(counts, F.col("observed"))).over(whole), F.sum(F.when(counts, F.col("g2"))).over(whole)
        rows = rows.withColumn("fast", F.greatest(F.when(t > 0, step * n / t).otherwise(F.col("typical")), F.col("least")))
    return rows.withColumn("expected", F.when(F.col("slow"), step / F.col("I")).otherwise(F.col("fast"))).drop("g2", "use", "least", "typical", "fast")


def _rate_change(rows: DataFrame, keys: list[str], step: int) -> Column:
    """Does this bucket lie in the half of the series whose sample rate is at least twice, or half, the other's, clearly
    apart, and the farther from the whole's median?"""
    order, whole = Window.partitionBy(*keys).orderBy("ts_ms"), Window.partitionBy(*keys)
    by_gap = F.max(F.col("slow").cast("int")).over(whole) == 1
    r = F.when(F.col("full"), F.when(by_gap, F.col("observed") * step / F.col("g")).otherwise(F.col("observed")))
    n = F.count(r).over(whole)
    late = F.when(r.isNotNull(), F.count(r).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1 >= F.floor(n / 2))
    half = {"e": F.when(~late, r), "l": F.when(late, r)}
    # Windows do not nest: the halves are columns first.
    of = lambda f, name: f(F.col(f"r_{name}"))
    q = lambda share: lambda c: F.percentile(c, F.lit(share)).over(whole)
    mean = lambda c: F.avg(c).over(whole)
    count = lambda c: F.count(c).over(whole)
    me, ml = of(mean, "e"), of(mean, "l")
    apart = F.when(ml >= me, of(q(0.25), "l") > of(q(0.75), "e")).otherwise(of(q(0.25), "e") > of(q(0.75), "l"))
    base = F.greatest(q(0.5)(F.coalesce("r_e", "r_l")), F.lit(1e-9))
    odd_late = F.abs(F.log(of(q(0.5), "l") / base)) >= F.abs(F.log(of(q(0.5), "e") / base))
    stands = (of(count, "e") >= CHANGE_BUCKETS) & (of(count, "l") >= CHANGE_BUCKETS) & (F.greatest(me, ml) >= CHANGE * F.least(me, ml)) & apart
    side = F.when(odd_late, F.col("r_l")).otherwise(F.col("r_e"))
    inside = (F.col("ts_ms") >= F.min("odd_t").over(whole)) & (F.col("ts_ms") <= F.max("odd_t").over(whole))
    return half, stands, side, inside


def _changed(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    half, stands, side, inside = _rate_change(rows, keys, step)
    rows = rows.withColumns({"r_e": half["e"], "r_l": half["l"]}).withColumns({"stands": stands, "side": side})
    rows = rows.withColumn("odd_t", F.when(F.col("stands") & F.col("side").isNotNull(), F.col("ts_ms")))
    return rows.withColumn("changed", F.coalesce(inside, F.lit(False))).drop("r_e", "r_l", "stands", "side", "odd_t")


def by_cadence(
    counts: DataFrame,
    keys: list[str],
    step: int,
    start: int,
    end: int,
    failed: DataFrame | None = None,
    ended: DataFrame | None = None,
    resets: DataFrame | None = None,
    resolution: int | None = None,
    post_gap: int = 1,
) -> DataFrame:
    """(keys, ts_ms, observed, expected, state, flags) of every bucket of (start, end] of each series with a sample in it.

    counts: (keys, ts_ms, observed), one row a bucket, ts_ms its end. failed: spans (a, b) of time that the source could not
    answer; a bucket that meets one is UNKNOWN and expects nothing. ended: keys of series that a staleness marker ended;
    their silence is SUSPECT. resets: (keys, ts_ms) of buckets in which a counter fell. resolution: the source's own
    interval in milliseconds, where it is known and not assumed. post_gap: buckets after a gap that a difference reaches
    back over."""
    nz = counts.filter((F.col("observed") > 0) & (F.col("ts_ms") > start) & (F.col("ts_ms") <= end)).select(*keys, "ts_ms", F.col("observed").cast("double").alias("observed"))
    if failed is not None:
        nz = in_spans(nz, failed, step).filter(~F.col("failed")).drop("failed")
    # One shuffle by series; every window below is met by it.
    rows = _laid_out(_judged(nz.repartition(*keys), keys, step), keys, step, start, end)
    rows = in_spans(rows, failed, step).withColumnRenamed("failed", "unk") if failed is not None else rows.withColumn("unk", F.lit(False))
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    blind = F.last(F.when(F.col("unk"), F.col("ts_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ref", F.greatest("ref", blind))
    rows = _skips(_spilled(rows, keys, step), keys, step, resolution)
    late = F.coalesce(F.col("ts_ms") - F.col("ref") > F.greatest(SLOW_MISS * F.col("I"), F.col("I") + step), F.lit(True))
    rows = rows.withColumn("missed", F.when(F.col("slow"), late).otherwise(~F.col("spilled")) & ~F.col("cad"))
    rows = _changed(_expected(rows, keys, step), keys, step)
    unknown = F.col("unk") | F.col("undet")
    state = F.when(unknown, UNKNOWN).when(F.col("absent"), ABSENT).when(F.col("observed") == 0, F.when(F.col("missed"), EMPTY).otherwise(OK))
    state = state.when(F.col("slow"), OK).when(short(F.col("observed"), F.col("expected")), PARTIAL).otherwise(OK)
    rows = rows.withColumn("state", state)
    marks = [F.when(F.col("undet"), CADENCE).otherwise(0), F.when(F.col("changed"), INTERVAL_CHANGE).otherwise(0)]
    if ended is not None:
        rows = rows.join(ended.select(*keys).distinct().withColumn("over", F.lit(True)), keys, "left")
        rows = rows.withColumn("state", F.when((F.col("state") == EMPTY) & F.col("over") & F.col("trailing"), SUSPECT).otherwise(F.col("state")))
        marks.append(F.when(F.col("state") == SUSPECT, STALE_MARKER).otherwise(0))
    if resets is not None:
        rows = rows.join(resets.select(*keys, "ts_ms").distinct().withColumn("fell", F.lit(True)), [*keys, "ts_ms"], "left")
        marks.append(F.when(F.col("fell"), RESET).otherwise(0))
    if post_gap:
        gap = F.col("state").isin(EMPTY, UNKNOWN)
        since = F.last(F.when(gap, F.col("ts_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        marks.append(F.when(~gap & (F.col("state") != ABSENT) & (F.col("ts_ms") - since <= post_gap * step), POST_GAP).otherwise(0))
    flags = marks[0]
    for m in marks[1:]:
        flags = flags.bitwiseOR(m)
    nothing = lambda c: F.when(unknown, 0.0).otherwise(F.col(c)).alias(c)
    return rows.select(*keys, "ts_ms", nothing("observed"), nothing("expected"), "state", flags.alias("flags"))


def settle_unobserved(values: DataFrame, states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """values on the buckets of their states: a rate or count of a bucket in which the source was alive and gave nothing is
    0 (EMPTY), while one that nobody could see (UNKNOWN, SUSPECT, ABSENT) stays unknown and any value in it is dropped."""
    joined = states.select(*keys, "ts_ms", "state").join(values.select(*keys, "ts_ms", value), [*keys, "ts_ms"], "left")
    seen = F.col("state").isin(OK, PARTIAL)
    settled = F.when(seen, F.col(value)).when(F.col("state") == EMPTY, F.coalesce(F.col(value), F.lit(0.0)))
    return joined.withColumn(value, settled)


def post_gap_buckets(width: int, step: int) -> int:
    """Buckets after a gap whose difference over a window of that width may reach back over the gap."""
    return -(-width // step)
