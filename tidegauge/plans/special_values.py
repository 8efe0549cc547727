"""Queries over samples with NaN in them and with several samples at one time: NaN neither rises nor falls, is passed over
by a maximum, and equal times give no rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import ieee
from tidegauge.operators import discovery, ranges, series, vectors
from tidegauge.plans.catalogue import _EXTRA, HALF_DAY, HOUR, KEY, SIX, C, S, end, rounded, vector, windows
from tidegauge.registry import register
from tidegauge.sources import events as src

#: Each so-manieth sample of a series is NaN.
EVERY = 97

# --- the same in SQL: gauge and counter with NaN, and a counter whose times are cut to six hours ---
NG = f"{S}, NG AS (SELECT event_type, ts_ms, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) % {EVERY} = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM (SELECT event_type, ts_ms, max(value) AS value FROM S GROUP BY ALL))"
NC = f"{C}, NC AS (SELECT event_type, ts_ms, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) % {EVERY} = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM C)"
EC = f"{C}, EC AS (SELECT event_type, ts_ms // {SIX} * {SIX} AS ts_ms, value FROM C)"


def _with_nan(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("event_type").orderBy("ts_ms"))
    return rows.withColumn("value", F.when(place % EVERY == 0, F.lit(ieee.NAN)).otherwise(F.col("value")))


def gauge(s: SparkSession, d: str) -> DataFrame:
    return _with_nan(src.gauge(s, d))


def counter(s: SparkSession, d: str) -> DataFrame:
    return _with_nan(src.counter(s, d))


def same_times(s: SparkSession, d: str) -> DataFrame:
    return src.counter(s, d).withColumn("ts_ms", (F.floor(F.col("ts_ms") / SIX) * SIX).cast("long"))


_FELL = "value < p AND NOT isnan(value) AND NOT isnan(p)"
_ORDER = "PARTITION BY event_type, t ORDER BY ts_ms, value"
_NAN_EXTRA = _EXTRA.replace("CASE WHEN value < p THEN p END", f"CASE WHEN {_FELL} THEN p END").replace("PARTITION BY event_type, t ORDER BY ts_ms", _ORDER)
# Samples of one time are ordered by value; the first and last of a window are those of that order.
_SAME_EXTRA = _NAN_EXTRA.replace("arg_min(value, ts_ms)", "first(value ORDER BY ts_ms, value)").replace("arg_max(value, ts_ms)", "last(value ORDER BY ts_ms, value)").replace("WHERE n >= 2", "WHERE n >= 2 AND b > a")

for _name, _counter, _per in (("rate", True, True), ("increase", True, False), ("delta", False, False)):
    _x0 = "CASE WHEN ch > 0 AND NOT isnan(ch) AND f >= 0 AND NOT isnan(f) THEN least(x0, sp * f / ch) ELSE x0 END" if _counter else "x0"
    for _kind, _from, _source, _sql, _rows in (("with_nan", NC, "NC", _NAN_EXTRA, counter), ("same_times", EC, "EC", _SAME_EXTRA, same_times)):
        register(f"{_name}_{_kind}", f"WITH {_from}, {windows(_source, SIX, HALF_DAY)}" + _sql.format(lost="+ sum(lost)" if _counter else "", w=HALF_DAY, x0=_x0, per=HALF_DAY / 1000 if _per else 1.0))(
            lambda s, d, c=_counter, p=_per, rows=_rows: rounded(ranges.extrapolated(rows(s, d), KEY, SIX, HALF_DAY, c, p), "value")
        )
register("resets_with_nan", f"WITH {NC}, {windows('NC', SIX, HALF_DAY)}, P AS (SELECT *, lag(value) OVER ({_ORDER}) AS p FROM W) SELECT event_type, t, CAST(count(*) FILTER ({_FELL}) AS BIGINT) AS value FROM P GROUP BY ALL")(lambda s, d: ranges.pairwise(counter(s, d), KEY, SIX, HALF_DAY, True))
register(
    "irate_with_nan",
    f"WITH {NC}, {windows('NC', SIX, HALF_DAY)}, P AS (SELECT *, lag(value) OVER o AS p, lag(ts_ms) OVER o AS pt, row_number() OVER (PARTITION BY event_type, t ORDER BY ts_ms DESC) AS k FROM W WINDOW o AS ({_ORDER})) SELECT event_type, t, round(CASE WHEN {_FELL} THEN value ELSE value - p END / ((ts_ms - pt) / 1000.0), 7) AS value FROM P WHERE k = 1 AND p IS NOT NULL",
)(lambda s, d: rounded(ranges.instant(counter(s, d), KEY, SIX, HALF_DAY, True), "value"))
register("max_over_time_with_nan", f"WITH {NG}, {windows('NG', SIX, HALF_DAY)} SELECT event_type, t, coalesce(max(value) FILTER (NOT isnan(value)), max(value)) AS value FROM W GROUP BY event_type, t")(lambda s, d: ranges.folded(gauge(s, d), KEY, SIX, HALF_DAY, "max"))
register("min_over_time_with_nan", f"WITH {NG}, {windows('NG', SIX, HALF_DAY)} SELECT event_type, t, coalesce(min(value) FILTER (NOT isnan(value)), max(value)) AS value FROM W GROUP BY event_type, t")(lambda s, d: ranges.folded(gauge(s, d), KEY, SIX, HALF_DAY, "min"))
register("reset_buckets_with_nan", f"WITH {NC}, L AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms) AS p FROM NC) SELECT event_type, {end(HOUR)} AS ts_ms, count(*) AS resets FROM L WHERE {_FELL} GROUP BY ALL")(lambda s, d: discovery.reset_buckets(counter(s, d), KEY, HOUR))
register(
    "scan_with_nan",
    f"WITH {NC}, L AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms) AS d FROM NC) SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS negatives, count(*) FILTER (d > 0 AND NOT isnan(d)) AS increases, count(*) FILTER (d < 0) AS decreases, count(*) FILTER (d = 0) AS constants, CAST(bool_and(value = floor(value)) FILTER (NOT isnan(value)) AS INTEGER) AS integral FROM L GROUP BY ALL",
)(lambda s, d: series.scan(counter(s, d), KEY))

_VX = "VX AS (SELECT t, event_type, instance, CASE WHEN CAST(floor(value * 1000) AS BIGINT) % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM X)"


def _vector(s: SparkSession, d: str) -> DataFrame:
    return vector(s, d).withColumn("value", F.when(F.floor(F.col("value") * 1000) % 5 == 0, F.lit(ieee.NAN)).otherwise(F.col("value")))


def _register_vector() -> None:
    from tidegauge.plans.catalogue import X

    register("agg_max_with_nan", f"WITH {X}, {_VX} SELECT t, event_type, round(coalesce(max(value) FILTER (NOT isnan(value)), max(value)), 7) AS value FROM VX GROUP BY t, event_type")(lambda s, d: rounded(vectors.aggregate(_vector(s, d), KEY, "max"), "value"))
    register("round_to_zero", f"WITH {X} SELECT t, event_type, instance, 'NaN'::DOUBLE AS value FROM X")(lambda s, d: vector(s, d).withColumn("value", ieee.round_to(F.col("value"), 0.0)))


_register_vector()
