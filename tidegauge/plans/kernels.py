"""Queries of the kernels that run once a series or a fleet. Where SQL can tell a part of the result, it stands beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import buckets, documents, per_series
from tidegauge.plans.catalogue import B, DAY, HOUR, KEY, S, SIX, end, rounded
from tidegauge.registry import register
from tidegauge.sources import events as src
from tidegauge.session import make_importable


def hourly(s: SparkSession, d: str) -> DataFrame:
    make_importable(s)
    return src.buckets(s, d, HOUR)


def six_hours(s: SparkSession, d: str) -> DataFrame:
    make_importable(s)
    return src.buckets(s, d, SIX)


def shards(s: SparkSession, d: str) -> DataFrame:
    """Daily means of 40 members of each type."""
    make_importable(s)
    rows = src.table(s, d, "events").select("event_type", (F.col("user_id") % 40).alias("instance"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")
    return buckets.rollup(rows, ["event_type", "instance"], DAY)


def _range(s: SparkSession, d: str) -> tuple[int, int]:
    return tuple(-(-x // HOUR) * HOUR for x in src.samples(s, d).agg(F.min("ts_ms"), F.max("ts_ms")).first())


def _middle(s: SparkSession, d: str) -> int:
    a, b = _range(s, d)
    return (a + b) // 2


_P = f"{B}, P AS (SELECT event_type, avg, (ts_ms - min(ts_ms) OVER (PARTITION BY event_type)) // {HOUR} AS p, max(ts_ms) OVER (PARTITION BY event_type) - min(ts_ms) OVER (PARTITION BY event_type) AS span FROM B)"
register("series_trend", f"WITH {_P} SELECT event_type, count(*) AS n, round(regr_slope(avg, p), 7) AS slope FROM P GROUP BY event_type")(lambda s, d: rounded(per_series.stability(hourly(s, d), KEY, "avg", HOUR).select("event_type", "n", "slope"), "slope"))
register(
    "series_variance_ratio",
    f"WITH {_P}, Q AS (SELECT event_type, avg, CASE WHEN p < (span // {HOUR} + 1) / 3.0 THEN 1 WHEN p >= 2 * (span // {HOUR} + 1) / 3.0 THEN 3 END AS third FROM P), M AS (SELECT event_type, third, mad(avg) AS m FROM Q WHERE third IS NOT NULL GROUP BY ALL) SELECT event_type, round(max(m) FILTER (third = 3) / max(m) FILTER (third = 1), 7) AS variance_ratio FROM M GROUP BY event_type",
)(lambda s, d: rounded(per_series.stability(hourly(s, d), KEY, "avg", HOUR).select("event_type", "variance_ratio"), "variance_ratio"))
register("series_shape", f"WITH {B}, D AS (SELECT event_type, avg - avg(avg) OVER (PARTITION BY event_type) AS d FROM B) SELECT event_type, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurtosis FROM D GROUP BY event_type")(
    lambda s, d: rounded(per_series.stability(hourly(s, d), KEY, "avg", HOUR).select("event_type", "skew", "kurtosis"), "skew", "kurtosis", digits=6)
)
_LAGS = "CAST(floor(12 * pow(n / 100.0, 0.25)) AS INT)"
register(
    "series_kpss",
    f"WITH {B}, E AS (SELECT event_type, row_number() OVER o AS i, count(*) OVER (PARTITION BY event_type) AS n, avg - avg(avg) OVER (PARTITION BY event_type) AS e FROM B WINDOW o AS (PARTITION BY event_type ORDER BY ts_ms)), C AS (SELECT event_type, sum(c * c) AS top FROM (SELECT event_type, sum(e) OVER (PARTITION BY event_type ORDER BY i) AS c FROM E) GROUP BY ALL), G AS (SELECT a.event_type, any_value(a.n) AS n, b.i - a.i AS lag, sum(a.e * b.e) / any_value(a.n) AS g FROM E a JOIN E b ON a.event_type = b.event_type AND b.i >= a.i AND b.i - a.i <= {_LAGS.replace('n /', 'a.n /')} GROUP BY a.event_type, b.i - a.i), V AS (SELECT event_type, any_value(n) AS n, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / ({_LAGS} + 1)) * g END) AS s2 FROM G GROUP BY event_type) SELECT event_type, round(top / (n * n * s2), 6) AS kpss FROM C JOIN V USING (event_type)",
)(lambda s, d: rounded(per_series.stability(hourly(s, d), KEY, "avg", HOUR).select("event_type", "kpss"), "kpss", digits=6))
register("series_stability")(lambda s, d: per_series.stability(hourly(s, d), KEY, "avg", HOUR))
register("changepoints")(lambda s, d: per_series.changepoints(hourly(s, d).withColumn("v", F.col("avg") + F.when(F.col("ts_ms") > _middle(s, d), 60).otherwise(0)), KEY, "v", HOUR))
register("diagnose")(lambda s, d: per_series.diagnosis(hourly(s, d), KEY, "avg", HOUR))
register("spectrum_peaks")(lambda s, d: per_series.peaks(hourly(s, d).withColumn("v", F.col("avg") + 30 * F.sin(F.col("ts_ms") * (2 * 3.141592653589793 / DAY))), KEY, "v", HOUR, 3))
register("spectrogram")(lambda s, d: per_series.spectrogram(hourly(s, d), KEY, "avg", HOUR, 96, [DAY / 2, DAY, 2 * DAY]))
register("filter_lowpass")(lambda s, d: per_series.filtered(six_hours(s, d), KEY, "avg", SIX, "low", high_ms=2 * DAY))
register("filter_highpass")(lambda s, d: per_series.filtered(six_hours(s, d), KEY, "avg", SIX, "high", low_ms=2 * DAY))
register("filter_bandpass")(lambda s, d: per_series.filtered(six_hours(s, d), KEY, "avg", SIX, "band", low_ms=4 * DAY, high_ms=DAY))
register("control_chart")(lambda s, d: per_series.control_chart(hourly(s, d), KEY, "avg", HOUR, _middle(s, d)))
register("excursion")(lambda s, d: per_series.excursions(six_hours(s, d), KEY, "avg", SIX, _middle(s, d)))
register("fleet_outliers")(lambda s, d: per_series.fleet_outliers(shards(s, d).withColumn("avg", F.col("avg") + F.when(F.col("instance") == 7, 200).otherwise(0)), KEY, "instance", "avg"))
register("fleet_groups")(lambda s, d: per_series.fleet_groups(shards(s, d).withColumn("avg", F.col("avg") + F.when(F.col("instance") < 15, 300).otherwise(0)), KEY, "instance", "avg"))
register("seasonal_compare")(lambda s, d: _seasonal(s, d))


def _seasonal(s: SparkSession, d: str) -> DataFrame:
    last = _range(s, d)[1]
    return per_series.seasonal(hourly(s, d), KEY, "avg", HOUR, last - DAY, last, DAY, 7)


@register("littles_law_check")
def _littles(s: SparkSession, d: str) -> DataFrame:
    """Each event is taken for a request that lasts value minutes: arrivals, latencies and the level follow from the same spans."""
    make_importable(s)
    spans = src.samples(s, d).select("event_type", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.floor("value") * 60_000).alias("end_ms"))
    level = documents.in_flight(spans, KEY, SIX).select("event_type", "ts_ms", F.col("avg").alias("level"))
    counted = spans.groupBy("event_type", ((F.floor(F.col("start_ms") / SIX) + 1) * SIX).cast("long").alias("ts_ms")).agg(F.count("*").cast("double").alias("arrivals"), F.sum((F.col("end_ms") - F.col("start_ms")) / 1000).alias("latency_sum"), F.count("*").cast("double").alias("latency_count"))
    return per_series.littles_law(counted.join(level, ["event_type", "ts_ms"]), KEY, SIX / 1000)


register("in_flight_extremes", f"WITH {S}, P AS (SELECT event_type, ts_ms AS a, ts_ms + 60000 + CAST(floor(value) AS BIGINT) * 1000 AS b FROM S), E AS (SELECT event_type, a AS moment, 1 AS d FROM P UNION ALL SELECT event_type, b, -1 FROM P), N AS (SELECT event_type, moment, sum(d) AS d FROM E GROUP BY ALL), L AS (SELECT event_type, moment, sum(d) OVER (PARTITION BY event_type ORDER BY moment) AS level, lead(moment) OVER (PARTITION BY event_type ORDER BY moment) AS until FROM N), Z AS (SELECT event_type, min(moment) AS f, max(moment) AS l FROM N GROUP BY ALL), LL AS (SELECT event_type, moment, level, until FROM L WHERE until IS NOT NULL UNION ALL SELECT event_type, (f // {HOUR}) * {HOUR}, 0, f FROM Z WHERE f % {HOUR} > 0 UNION ALL SELECT event_type, l, 0, (l // {HOUR}) * {HOUR} + {HOUR} FROM Z), X AS (SELECT event_type, level, moment, until, unnest(generate_series((moment // {HOUR}) * {HOUR} + {HOUR}, ((until + {HOUR - 1}) // {HOUR}) * {HOUR}, {HOUR})) AS ts_ms FROM LL) SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, CAST(min(level) AS BIGINT) AS min, CAST(max(level) AS BIGINT) AS max FROM X GROUP BY ALL HAVING max(level) > 0")(
    lambda s, d: documents.in_flight(src.samples(s, d).select("event_type", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 60000 + F.floor("value") * 1000).alias("end_ms")), KEY, HOUR).filter("max > 0").select("event_type", "ts_ms", "min", "max")
)
