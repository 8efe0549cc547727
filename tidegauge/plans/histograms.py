"""Histogram metrics as distributions, from counters made of events: one by edge, one by range, one whole histogram a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import bucket_end
from tidegauge.operators import metric_histograms as mh
from tidegauge.plans.catalogue import _EXTRA, KEY, SIX, S, end, rounded, windows
from tidegauge.registry import register
from tidegauge.sources import events as src

_EDGES = ("10", "50", "100", "500", "+Inf")
#: Samples after which a series' counters start anew.
_LIFE = 60
_BOTH = ["event_type", "instance"]


def _lives(s: SparkSession, d: str) -> DataFrame:
    rows = src.samples(s, d).groupBy(*_BOTH, "ts_ms").agg(F.max("value").alias("value"))
    place = F.row_number().over(Window.partitionBy(*_BOTH).orderBy("ts_ms"))
    return rows.withColumn("life", F.floor((place - 1) / _LIFE))


def classic_points(s: SparkSession, d: str) -> DataFrame:
    """A counter for each series and edge: how many values at or below it so far."""
    rows = _lives(s, d).withColumn("le", F.explode(F.array(*[F.lit(e) for e in _EDGES])))
    edge = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").try_cast("double"))
    upto = Window.partitionBy(*_BOTH, "le", "life").orderBy("ts_ms")
    labels = F.to_json(F.struct(F.lit("size_bucket").alias("__name__"), "event_type", "instance", "le"))
    return rows.select(labels.alias("labels"), "ts_ms", F.sum((F.col("value") <= edge).cast("double")).over(upto).alias("value"))


_INST = f"{S}, GI AS (SELECT event_type, instance, ts_ms, max(value) AS value FROM S GROUP BY ALL), LI AS (SELECT *, (row_number() OVER (PARTITION BY event_type, instance ORDER BY ts_ms) - 1) // {_LIFE} AS life FROM GI)"
_LE = ", ".join(f"({'1e308' if e == '+Inf' else e}::DOUBLE)" for e in _EDGES)
_HB = f"{_INST}, HB AS (SELECT event_type, instance, le, ts_ms, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, instance, le, life ORDER BY ts_ms) AS DOUBLE) AS value FROM LI, (VALUES {_LE}) e(le))"


def _risen(source: str, labels: str) -> str:
    """What each series rose by a window of six hours, every six hours, as rows IN_(labels, t, v)."""
    body = _EXTRA.replace("event_type, t", f"{labels}, t").format(lost="+ sum(lost)", w=SIX, x0="CASE WHEN ch > 0 AND f >= 0 THEN least(x0, sp * f / ch) ELSE x0 END", per=1.0)
    ctes, last = body.rsplit("SELECT", 1)
    raw = last.replace("round(", "").replace(", 7) AS value", " AS v")
    return f"{windows(source, SIX, SIX)}{ctes.rstrip()}, IN_ AS (SELECT{raw})"


_CLASSIC = f"{_HB}, {_risen('HB', 'event_type, instance, le')}, MX AS (SELECT event_type, le, t AS ts_ms, sum(v) AS v FROM IN_ GROUP BY ALL), CM AS (SELECT *, max(v) OVER w AS c, lag(le) OVER w AS lo FROM MX WINDOW w AS (PARTITION BY event_type, ts_ms ORDER BY le)), BK AS (SELECT event_type, ts_ms, lo, le, v, c, c - coalesce(lag(c) OVER (PARTITION BY event_type, ts_ms ORDER BY le), 0) AS n FROM CM)"


def classic(s: SparkSession, d: str) -> mh.Histogram:
    return mh.fetch(classic_points(s, d), KEY, SIX)


def _edges_as_numbers(df: DataFrame) -> DataFrame:
    """Open edges as -1 and 1e308, so that every cell compares as a number."""
    return df.withColumn("bucket_lo", F.when(F.col("bucket_lo") == float("-inf"), -1.0).otherwise(F.col("bucket_lo"))).withColumn("bucket_hi", F.when(F.col("bucket_hi") == float("inf"), 1e308).otherwise(F.col("bucket_hi")))


register("fetch_histogram", f"WITH {_CLASSIC} SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, coalesce(lo, -1) AS bucket_lo, le AS bucket_hi, round(n, 6) AS count FROM BK WHERE n > 1e-9")(lambda s, d: rounded(_edges_as_numbers(classic(s, d).rows.filter("count > 1e-9")), "count", digits=6))
register("histogram_columns", f"WITH {_CLASSIC} SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, round(max(c), 6) AS n, CAST(bool_or(c - v > 1e-9 * greatest(1, c)) AS INTEGER) AS repaired, CAST(bool_or(abs(n - round(n)) > 1e-6) AS INTEGER) AS estimated FROM BK GROUP BY ALL")(
    lambda s, d: rounded(classic(s, d).columns.withColumn("repaired", F.col("repaired").cast("int")).withColumn("estimated", F.col("estimated").cast("int")), "n", digits=6)
)
register("histogram_answered", f"WITH {_CLASSIC}, CO AS (SELECT event_type, ts_ms, max(c) AS n FROM BK GROUP BY ALL), ED AS (SELECT min(ts_ms) AS a, max(ts_ms) AS b FROM CO), GR AS (SELECT event_type, unnest(generate_series(a, b, {SIX})) AS ts_ms FROM (SELECT DISTINCT event_type FROM CO), ED) SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, round(n, 6) AS n FROM GR LEFT JOIN CO USING (event_type, ts_ms)")(
    lambda s, d: rounded(_on_grid(classic(s, d)), "n", digits=6)
)
register("histogram_mean_bounds", f"WITH {_CLASSIC} SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, round(sum(coalesce(lo, 0) * n) / sum(n), 6) AS lo, CASE WHEN count(*) FILTER (le > 1e300) = 0 THEN round(sum(le * n) / sum(n), 6) END AS hi FROM BK WHERE n > 1e-9 GROUP BY ALL")(
    lambda s, d: rounded(mh.mean_of(_kept(classic(s, d)), F.lit(0.0)), "lo", "hi", digits=6)
)


def _kept(h: mh.Histogram) -> mh.Histogram:
    return mh.Histogram(h.rows.filter("count > 1e-9"), h.columns, h.form, h.keys)


def _on_grid(h: mh.Histogram) -> DataFrame:
    edge = h.columns.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).withColumn("k", F.lit(0))
    grid = h.columns.select("event_type").distinct().withColumn("k", F.lit(0)).join(edge, "k").select("event_type", F.explode(F.sequence("a", "b", F.lit(SIX).cast("long"))).alias("ts_ms"))
    return mh.answered(h, grid)


register("histogram_scheme", f"WITH {_CLASSIC}, EG AS (SELECT DISTINCT event_type, unnest([lo, le]) AS e FROM BK WHERE n > 0), K AS (SELECT e FROM EG WHERE e < 1e300 GROUP BY e HAVING count(*) = (SELECT count(DISTINCT event_type) FROM BK WHERE n > 0)) SELECT 'classic' AS form, string_agg(CAST(CAST(e AS INTEGER) AS VARCHAR), ',' ORDER BY e) AS edges FROM K")(
    lambda s, d: classic(s, d).scheme().select("form", F.array_join(F.transform("edges", lambda e: e.cast("int").cast("string")), ",").alias("edges"))
)


# --- counters by range: a series begins with the first value in its range ---
def range_points(s: SparkSession, d: str) -> DataFrame:
    low = (F.floor(F.col("value") / 25) * 25).cast("int")
    rows = _lives(s, d).withColumn("vmrange", F.concat(low.cast("string"), F.lit("..."), (low + 25).cast("string")))
    upto = Window.partitionBy(*_BOTH, "vmrange", "life").orderBy("ts_ms")
    labels = F.to_json(F.struct(F.lit("size_bucket").alias("__name__"), "event_type", "instance", "vmrange"))
    return rows.select(labels.alias("labels"), "ts_ms", F.count("*").over(upto).cast("double").alias("value"))


_VB = f"{_INST}, VB AS (SELECT event_type, instance, CAST(floor(value / 25) * 25 AS DOUBLE) AS le, ts_ms, CAST(count(*) OVER (PARTITION BY event_type, instance, floor(value / 25), life ORDER BY ts_ms) AS DOUBLE) AS value FROM LI), {_risen('VB', 'event_type, instance, le')}"
register("fetch_histogram_ranges", f"WITH {_VB}, MX AS (SELECT event_type, t AS ts_ms, le AS bucket_lo, le + 25 AS bucket_hi, sum(v) AS n FROM IN_ GROUP BY ALL) SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, bucket_lo, bucket_hi, round(n, 6) AS count FROM MX WHERE n > 1e-9")(
    lambda s, d: rounded(mh.fetch(range_points(s, d), KEY, SIX).rows.filter("count > 1e-9"), "count", digits=6)
)


# --- whole histograms: powers of two a sample, as a native histogram with schema 0 has them ---
def native_samples(s: SparkSession, d: str) -> DataFrame:
    top = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(F.col("value"), F.lit(1e-9)))))
    cells = src.samples(s, d).groupBy(*_BOTH, bucket_end(F.col("ts_ms"), SIX).alias("ts_ms"), top.alias("e")).agg(F.count("*").cast("double").alias("count"))
    bucket = F.struct(F.pow(F.lit(2.0), F.col("e") - 1).alias("lo"), F.pow(F.lit(2.0), F.col("e")).alias("hi"), "count")
    return cells.groupBy(*_BOTH, "ts_ms").agg(F.collect_list(bucket).alias("buckets"))


register("fetch_histogram_native", f"WITH {S}, N AS (SELECT event_type, {end(SIX)} AS ts_ms, greatest(0, ceil(log2(greatest(value, 1e-9)))) AS e FROM S) SELECT event_type, ts_ms, power(2, e - 1) AS bucket_lo, power(2, e) AS bucket_hi, CAST(count(*) AS DOUBLE) AS count FROM N GROUP BY ALL")(lambda s, d: mh.from_native(native_samples(s, d), KEY).rows)
register("histogram_native_scheme", "SELECT 'native' AS form, 0 AS schema FROM (SELECT count(*) AS n FROM events) WHERE n > 0")(lambda s, d: mh.from_native(native_samples(s, d), KEY).scheme().select("form", "schema"))
