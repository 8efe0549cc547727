"""Queries over what a source holds and over requests, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import discovery
from tidegauge.plans.catalogue import B, C, DAY, G, HOUR, KEY, S, SIX, end, left_end, rounded
from tidegauge.plans.shapes import values
from tidegauge.query import parser
from tidegauge.query.evaluate import Evaluator, points
from tidegauge.registry import register
from tidegauge.sources import esquery
from tidegauge.sources import events as src

_BOTH = ["event_type", "instance"]


def labelled(s: SparkSession, d: str) -> DataFrame:
    return points(src.samples(s, d), "value", _BOTH)


register("discover_labels", f"WITH {S}, D AS (SELECT DISTINCT event_type, instance FROM S) SELECT 'value' AS metric, 'event_type' AS label, count(*) AS series, count(DISTINCT event_type) AS \"values\" FROM D UNION ALL SELECT 'value', 'instance', count(*), count(DISTINCT instance) FROM D")(lambda s, d: discovery.labels_of(labelled(s, d)))
register("label_values", f"WITH {S} SELECT DISTINCT CAST(instance AS VARCHAR) AS value FROM S WHERE event_type = 'click' ORDER BY value LIMIT 4")(lambda s, d: Evaluator(labelled(s, d)).label_values("instance", parser.parse('value{event_type="click"}').matchers, 4))
_T = 1704500000000
register("series_with_samples", f"WITH {S} SELECT DISTINCT event_type, CAST(instance AS VARCHAR) AS instance FROM S WHERE instance >= 5 AND ts_ms >= {_T} AND ts_ms <= {_T + DAY}")(
    lambda s, d: Evaluator(labelled(s, d)).series(parser.parse('value{instance=~"[5-9]"}').matchers, _T, _T + DAY).select(F.get_json_object("labels", "$.event_type").alias("event_type"), F.get_json_object("labels", "$.instance").alias("instance"))
)
register("instant_eval", f"WITH {S} SELECT event_type, round(sum(value), 7) AS value FROM (SELECT event_type, instance, avg(value) AS value FROM (SELECT event_type, instance, ts_ms, max(value) AS value FROM S GROUP BY ALL) WHERE ts_ms > {_T - DAY} AND ts_ms <= {_T} GROUP BY ALL) GROUP BY event_type")(
    lambda s, d: rounded(Evaluator(points(src.samples(s, d).groupBy(*_BOTH, "ts_ms").agg(F.max("value").alias("value")), "value", _BOTH)).instant("sum by (event_type) (avg_over_time(value[1d]))", _T).select(F.get_json_object("labels", "$.event_type").alias("event_type"), "value"), "value")
)
register("ended_series", f"WITH {S} SELECT event_type, instance, max(ts_ms) AS last FROM S GROUP BY ALL HAVING max(ts_ms) <= (SELECT max(ts_ms) FROM S) - {HOUR}")(
    lambda s, d: discovery.ended(src.samples(s, d), _BOTH, src.samples(s, d).agg(F.max("ts_ms")).first()[0], HOUR)
)
register("reset_buckets", f"WITH {C}, L AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms) AS p FROM C) SELECT event_type, {end(SIX)} AS ts_ms, count(*) AS resets FROM L WHERE value < p GROUP BY ALL")(lambda s, d: discovery.reset_buckets(src.counter(s, d), KEY, SIX))
register("learned_resolution", f"WITH {B}, L AS (SELECT event_type, ts_ms - lag(ts_ms) OVER (PARTITION BY event_type ORDER BY ts_ms) AS d FROM B), M AS (SELECT event_type, quantile_cont(d, 0.5) AS r FROM L GROUP BY ALL HAVING count(*) >= 3) SELECT CAST(r AS DOUBLE) AS resolution, count(*) AS series FROM M GROUP BY r ORDER BY series DESC, r LIMIT 1")(
    lambda s, d: discovery.resolution(src.buckets(s, d, HOUR), KEY)
)
register("member_label", "SELECT 'instance' AS label")(lambda s, d: discovery.member_label(points(src.samples(s, d).filter("event_type = 'click'"), "value", _BOTH)))
_TZ = "(1711846800000), (1711843200000), (1711850400000), (1729987200000), (1729990800000), (1729994400000), (1704067200000)"
register("local_hour_of_week", "SELECT * FROM (VALUES (1711843200000, 145, 3600000), (1711846800000, 147, 7200000), (1711850400000, 148, 7200000), (1729987200000, 146, 7200000), (1729990800000, 146, 3600000), (1729994400000, 147, 3600000), (1704067200000, 1, 3600000)) v(ts_ms, hour, utc_offset)")(
    lambda s, d: values(s, _TZ, "ts_ms").select("ts_ms", discovery.local_hour(F.col("ts_ms"), "Europe/Berlin").alias("hour"), discovery.utc_offset(F.col("ts_ms"), "Europe/Berlin").alias("utc_offset"))
)
_SH = "(1711931400000), (1711888200000), (1730120400000)"
register("same_clock_time_before", "SELECT * FROM (VALUES (1711931400000, 'none'), (1711888200000, '1711805400000'), (1730120400000, '1730034000000')) v(ts_ms, before)")(
    lambda s, d: values(s, _SH, "ts_ms").select("ts_ms", F.coalesce(discovery.shifted(F.col("ts_ms"), 1, "Europe/Berlin").cast("string"), F.lit("none")).alias("before"))
)
register("significant_digits", f"WITH {B} SELECT event_type, ts_ms, round(CASE WHEN avg = 0 THEN 0 ELSE round(avg * pow(10.0, 2 - floor(log10(abs(avg))))) / pow(10.0, 2 - floor(log10(abs(avg)))) END, 7) AS avg FROM B")(
    lambda s, d: rounded(src.buckets(s, d, HOUR).select("event_type", "ts_ms", discovery.significant(F.col("avg"), 3).alias("avg")), "avg")
)
register("group_values", f"WITH {S} SELECT event_type, ts_ms, round(sum(value), 7) AS value, count(*) AS samples FROM (SELECT event_type, instance, {end(SIX)} AS ts_ms, value FROM S WHERE instance <> 3) GROUP BY ALL")(
    lambda s, d: rounded(discovery.group_values(src.samples(s, d).select("event_type", F.when(F.col("instance") != 3, F.col("instance").cast("string")).alias("instance"), (F.ceil(F.col("ts_ms") / SIX) * SIX).cast("long").alias("ts_ms"), "value").filter("instance IS NOT NULL"), KEY, "sum"), "value")
)
register("against_limit", f"WITH {B}, L AS (SELECT ts_ms, max(max) AS l FROM B GROUP BY ALL) SELECT event_type, ts_ms, round(avg, 7) AS value, l AS \"limit\", round(l - avg, 7) AS \"left\", round(100 * avg / nullif(l, 0), 7) AS used FROM B JOIN L USING (ts_ms)")(
    lambda s, d: rounded(discovery.against_limit(src.buckets(s, d, HOUR).select("event_type", "ts_ms", F.col("avg").alias("value")), src.buckets(s, d, HOUR).groupBy("ts_ms").agg(F.max("max").alias("value")), []), "value", "left", "used")
)
register("fleet_heat", f"WITH {B}, M AS (SELECT ts_ms, median(avg) AS m, 1.4826 * mad(avg) AS s FROM B GROUP BY ALL) SELECT event_type, ts_ms, round((avg - m) / nullif(s, 0), 6) AS z FROM B JOIN M USING (ts_ms)")(lambda s, d: rounded(discovery.heat(src.buckets(s, d, HOUR), "event_type", "avg"), "z", digits=6))
register("fleet_cloud", f"WITH {B}, N AS (SELECT ts_ms, floor(avg / 20) * 20 AS bucket_lo, count(*) AS n FROM B GROUP BY ALL) SELECT ts_ms, bucket_lo, round(n / sum(n) OVER (PARTITION BY ts_ms), 7) AS share FROM N")(lambda s, d: rounded(discovery.cloud(src.buckets(s, d, HOUR), "avg", 20.0), "share"))
register("es_request", f"WITH {S} SELECT event_type, {left_end(HOUR)} AS ts_ms, round(sum(value * 2) / 3600, 7) AS value FROM S GROUP BY event_type, {left_end(HOUR)}")(
    lambda s, d: rounded(esquery.fetch(src.samples(s, d), {"group": ["event_type"], "metric": {"sum": {"field": "twice"}}}, HOUR, {"twice": "value * 2"}), "value")
)
