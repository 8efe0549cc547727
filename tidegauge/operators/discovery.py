"""What a source holds, and what its series are like: names, labels, spacing, resets, local hours, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.quantiles import quantiles
from tidegauge.operators.ranges import pairs
from tidegauge.operators.series import distances


def labels_of(points: DataFrame) -> DataFrame:
    """(metric, label, series, values): for each metric and label, how many series carry it with how many values. points
    are (labels as JSON text, ts_ms, value); only the distinct label sets are taken apart."""
    sets = points.select("labels").distinct().withColumn("m", F.from_json("labels", "map<string,string>"))
    rows = sets.select(F.col("m")["__name__"].alias("metric"), F.explode("m").alias("label", "v")).filter("label <> '__name__'")
    return rows.groupBy("metric", "label").agg(F.count("*").alias("series"), F.count_distinct("v").alias("values"))


def ended(points: DataFrame, keys: list[str], end: int, lookback: int) -> DataFrame:
    """Series whose last sample lies further back than the lookback at the end: they are over, not silent for a while."""
    return points.groupBy(*keys).agg(F.max("ts_ms").alias("last")).filter(F.col("last") <= end - lookback)


def reset_buckets(samples: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, ts_ms, resets) of buckets in which a counter fell. The fall is counted at the sample that shows it; falls
    from one bucket to the next are found at the buckets' borders, and NaN neither falls nor is fallen from."""
    fell = F.col("resets") + F.col("border_resets")
    return pairs(samples, keys, step).select(*keys, F.col("tile").alias("ts_ms"), fell.alias("resets")).filter("resets > 0")


def resolution(samples: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(resolution, series): the commonest median spacing of series with enough samples; the smaller of two as common."""
    each = quantiles(distances(samples, keys), keys, "d", {"resolution": 0.5}).filter(F.col("n") >= least - 1)
    return each.groupBy("resolution").agg(F.count("*").alias("series")).orderBy(F.desc("series"), "resolution").limit(1)


def member_label(points: DataFrame) -> DataFrame:
    """The label that tells all series apart by itself, the first by name."""
    sets = points.select("labels").distinct().withColumn("m", F.from_json("labels", "map<string,string>"))
    n = sets.count()
    each = sets.select(F.explode("m").alias("label", "v")).groupBy("label").agg(F.count_distinct("v").alias("values"))
    return each.filter((F.col("values") == n) & (F.col("label") != "__name__")).orderBy("label").limit(1).select("label")


def local_hour(ts_ms: Column, zone: str) -> Column:
    """Hour of the local week, Monday 00:00 being 0; with summer time, as clocks there show it."""
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)
    return (F.weekday(local) * 24 + F.hour(local)).cast("int")


def utc_offset(ts_ms: Column, zone: str) -> Column:
    """Milliseconds that clocks of a zone are ahead of UTC at a time."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)) - ts_ms


def shifted(ts_ms: Column, days: int, zone: str) -> Column:
    """The same time on the clock so many days before, null where clocks skipped it."""
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)
    wanted = local - F.make_dt_interval(F.lit(days))
    back = F.to_utc_timestamp(wanted, zone)
    return F.when(F.from_utc_timestamp(back, zone) == wanted, F.unix_millis(back))


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits; null where it is not finite."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def group_values(rows: DataFrame, by: list[str], how: str) -> DataFrame:
    """(by, ts_ms, value, samples) summed or averaged over the series of a group; series that lack a label are left out."""
    kept = rows.filter(" AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in by))
    return kept.groupBy(*by, "ts_ms").agg({"sum": F.sum("value"), "avg": F.avg("value")}[how].alias("value"), F.count("value").alias("samples"))


def against_limit(rows: DataFrame, limits: DataFrame, on: list[str]) -> DataFrame:
    """rows with their limit, what is left of it and the share used, matched on the labels that both carry."""
    joined = rows.join(limits.withColumnRenamed("value", "limit"), [*on, "ts_ms"])
    return joined.withColumn("left", F.col("limit") - F.col("value")).withColumn("used", F.try_divide(F.col("value") * 100, F.col("limit")))


def heat(rows: DataFrame, member: str, value: str) -> DataFrame:
    """(member, ts_ms, z): distance from the step's median by the step's median absolute deviation."""
    mid = rows.groupBy("ts_ms").agg(F.percentile(value, F.lit(0.5)).alias("m"))
    near = rows.join(mid, "ts_ms")
    spread = near.groupBy("ts_ms", "m").agg((F.percentile(F.abs(F.col(value) - F.col("m")), F.lit(0.5)) * 1.4826).alias("s"))
    return rows.join(spread, "ts_ms").select(member, "ts_ms", F.try_divide(F.col(value) - F.col("m"), F.col("s")).alias("z"))


def cloud(rows: DataFrame, value: str, width: float) -> DataFrame:
    """(ts_ms, bucket_lo, share): which share of the members lies in each bin of values at each step."""
    counted = rows.groupBy("ts_ms", (F.floor(F.col(value) / width) * width).cast("double").alias("bucket_lo")).agg(F.count("*").alias("n"))
    return counted.select("ts_ms", "bucket_lo", (F.col("n") / F.sum("n").over(Window.partitionBy("ts_ms"))).alias("share"))
