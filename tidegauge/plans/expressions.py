"""Queries given as expression text, evaluated over the whole events table, with the SQL that must give the same rows.

Metric value has the labels event_type and instance; metric hits counts by event_type and starts anew now and then.
The grid runs in steps of six hours from the first sample's to the last one's. M is avg_over_time(value[12h]) - 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import duration
from tidegauge.plans.catalogue import C, end, rounded
from tidegauge.query.evaluate import Evaluator, points
from tidegauge.registry import register
from tidegauge.sources import events as src

SIX, HALF_DAY, LOOKBACK = duration("6h"), duration("12h"), duration("5m")
M = "(avg_over_time(value[12h]) - 50)"
_GI = f"{C}, GI AS (SELECT event_type, CAST(instance AS VARCHAR) AS instance, ts_ms, max(value) AS value FROM S GROUP BY ALL), grid AS (SELECT unnest(generate_series((SELECT {end(SIX, 'min(ts_ms)')} FROM GI), (SELECT {end(SIX, 'max(ts_ms)')} FROM GI), {SIX})) AS t)"
_MM = f"{_GI}, M AS (SELECT t, event_type, instance, avg(value) - 50 AS value FROM grid JOIN GI ON ts_ms > t - {HALF_DAY} AND ts_ms <= t GROUP BY ALL)"
_V = f"{_GI}, V AS (SELECT t, event_type, instance, arg_max(value, ts_ms) AS value, max(ts_ms) AS ts_ms FROM grid JOIN GI ON ts_ms > t - {LOOKBACK} AND ts_ms <= t GROUP BY ALL)"
_H = f"{_GI}, H AS (SELECT t, event_type, arg_max(value, ts_ms) AS value FROM grid JOIN C ON ts_ms > t - {LOOKBACK} AND ts_ms <= t GROUP BY ALL)"


def evaluate(spark: SparkSession, sf_dir: str, text: str, *labels: str) -> DataFrame:
    """An expression's value at the grid's times, with the named labels as columns."""
    gauge = src.samples(spark, sf_dir).groupBy("event_type", "instance", "ts_ms").agg(F.max("value").alias("value"))
    both = {"value": points(gauge, "value", ["event_type", "instance"]), "hits": points(src.counter(spark, sf_dir), "hits", ["event_type"])}
    ends = src.samples(spark, sf_dir).agg(F.min("ts_ms"), F.max("ts_ms")).first()
    start, stop = (-(-x // SIX) * SIX for x in ends)
    rows = Evaluator(both).range(text, start, stop, SIX)
    names = F.from_json("labels", "map<string,string>")
    return rounded(rows.select("t", *[F.try_element_at(names, F.lit(x)).alias(x) for x in labels], "value"), "value")


def _query(name: str, text: str, with_sql: str, select: str, *labels: str) -> None:
    register(f"expr_{name}", f"WITH {with_sql} SELECT t, {''.join(f'{x}, ' for x in labels)}round(CAST({select.split(' ; ')[0]} AS DOUBLE), 7) AS value {select.split(' ; ')[1]}")(lambda s, d: evaluate(s, d, text, *labels))


_BOTH = ("event_type", "instance")
for _name, _text, _sql in (
    ("abs", f"abs({M})", "abs(value)"),
    # 1e-4 keeps means that are whole numbers, whatever order they were summed in, on one side of a jump.
    ("ceil", f"ceil({M} + 1e-4)", "ceil(value + 1e-4)"),
    ("floor", f"floor({M} + 1e-4)", "floor(value + 1e-4)"),
    ("exp", f"exp({M} / 50)", "exp(value / 50)"),
    ("log2", f"log2(abs({M}) + 1)", "log2(abs(value) + 1)"),
    ("log10", f"log10(abs({M}) + 1)", "log10(abs(value) + 1)"),
    ("sgn", f"sgn({M} + 1e-4)", "sign(value + 1e-4)"),
    ("deg", f"deg({M})", "degrees(value)"),
    ("rad", f"rad({M})", "radians(value)"),
    ("round", f"round({M} + 1e-4, 0.5)", "floor((value + 1e-4) / 0.5 + 0.5) * 0.5"),
    ("clamp_min", f"clamp_min({M}, 0)", "greatest(value, 0)"),
    ("clamp_max", f"clamp_max({M}, 0)", "least(value, 0)"),
    ("neg", f"-{M}", "-value"),
    ("add", f"{M} + 1", "value + 1"),
    ("mul", f"2 * {M}", "2 * value"),
    ("pow", f"({M} ^ 2) ^ 0.25", "pow(pow(value, 2), 0.25)"),
    ("atan2", f"{M} atan2 10", "atan2(value, 10)"),
    ("mod", f"({M} + 1e-4) % 7", "value + 1e-4 - 7 * trunc((value + 1e-4) / 7)"),
    ("cmp_eq_bool", f"floor({M} + 1e-4) == bool 0", "floor(value + 1e-4) = 0"),
    ("cmp_ne_bool", f"floor({M} + 1e-4) != bool 0", "floor(value + 1e-4) <> 0"),
    ("cmp_lt_bool", f"{M} < bool 1e-4", "value < 1e-4"),
    ("cmp_ge_bool", f"1e-4 >= bool {M}", "1e-4 >= value"),
    ("time", f"{M} * 0 + time()", "t / 1000"),
    ("label_join", f'label_join({M}, "both", "/", "event_type", "instance")', "value"),
):
    _query(_name, _text, _MM, f"{_sql} ; FROM M", *_BOTH)

_query("cmp_le_filter", f"{M} <= 1e-4", _MM, "value ; FROM M WHERE value <= 1e-4", *_BOTH)
_query("clamp_empty", f"clamp({M}, 1, 0)", _MM, "value ; FROM M WHERE 1 > 2", *_BOTH)
_query("sel_instant", 'value{event_type=~"c.*|view"}', _V, "value ; FROM V WHERE event_type LIKE 'c%' OR event_type = 'view'", *_BOTH)
_query("sel_not_regex", 'value{event_type!~"c.*|view"}', _V, "value ; FROM V WHERE NOT (event_type LIKE 'c%' OR event_type = 'view')", *_BOTH)
_query("sel_name", '{__name__=~"val.*", instance!="3"}', _V, "value ; FROM V WHERE instance <> '3'", *_BOTH)
_query("timestamp", "timestamp(value)", _V, "ts_ms / 1000 ; FROM V", *_BOTH)
_query("offset", "value offset 6h", f"{_GI}, V AS (SELECT t, event_type, instance, arg_max(value, ts_ms) AS value FROM grid JOIN GI ON ts_ms > t - {SIX + LOOKBACK} AND ts_ms <= t - {SIX} GROUP BY ALL)", "value ; FROM V", *_BOTH)
_query("at_end", "max_over_time(value[6h] @ end())", f"{_GI}, E AS (SELECT event_type, instance, max(value) AS value FROM GI WHERE ts_ms > (SELECT max(t) FROM grid) - {SIX} AND ts_ms <= (SELECT max(t) FROM grid) GROUP BY ALL)", "value ; FROM E, grid", *_BOTH)
_query("by", f"sum by (event_type) ({M})", _MM, "sum(value) ; FROM M GROUP BY t, event_type", "event_type")
_query("without", f"max without (instance) ({M})", _MM, "max(value) ; FROM M GROUP BY t, event_type", "event_type")
_query("count_values", f'count_values("event_type", sgn({M} + 1e-4))', _MM, "count(*) ; FROM (SELECT t, CASE WHEN value > -1e-4 THEN '1' ELSE '-1' END AS event_type FROM M) GROUP BY t, event_type", "event_type")
_query("topk", f"topk by (event_type) (2, {M})", _MM, "value ; FROM M QUALIFY row_number() OVER (PARTITION BY t, event_type ORDER BY value DESC, instance) <= 2", *_BOTH)
_query("quantile_above_one", f"clamp_max(quantile by (event_type) (1.5, {M}), 1000)", _MM, "1000 ; FROM M GROUP BY t, event_type", "event_type")
_query("quantile_over_time_below_zero", "clamp_min(quantile_over_time(-1, hits[12h]), -1000)", f"{_GI}, H AS (SELECT t, event_type FROM grid JOIN C ON ts_ms > t - {HALF_DAY} AND ts_ms <= t GROUP BY ALL)", "-1000 ; FROM H", "event_type")
_PAIR = f"{_MM}, L AS (SELECT * FROM M WHERE event_type = 'click'), R AS (SELECT * FROM M WHERE event_type = 'view')"
_CLICK, _VIEW = (f'(avg_over_time(value{{event_type="{x}"}}[12h]) - 50)' for x in ("click", "view"))
_query("ignoring", f"{_CLICK} - ignoring(event_type) {_VIEW}", _PAIR, "L.value - R.value ; FROM L JOIN R USING (t, instance)", "instance")
_query("on_cmp", f"{_CLICK} > on(instance) {_VIEW}", _PAIR, "L.value ; FROM L JOIN R USING (t, instance) WHERE L.value > R.value", "instance")
_query("group_left", f"{M} / on(event_type) group_left() sum by (event_type) (abs({M}))", f"{_MM}, T AS (SELECT t, event_type, sum(abs(value)) AS total FROM M GROUP BY ALL)", "value / total ; FROM M JOIN T USING (t, event_type)", *_BOTH)
_query("group_right", f"count by (event_type) ({M}) * on(event_type) group_right() {M}", f"{_MM}, T AS (SELECT t, event_type, count(*) AS total FROM M GROUP BY ALL)", "value * total ; FROM M JOIN T USING (t, event_type)", *_BOTH)
_query("group_left_include", f'{_CLICK} * on(instance) group_left(kind) label_replace({_VIEW}, "kind", "$1-kind", "event_type", "(..).*")', _PAIR + ", K AS (SELECT t, L.event_type, instance, 'vi-kind' AS kind, L.value * R.value AS value FROM L JOIN R USING (t, instance))", "value ; FROM K", "event_type", "instance", "kind")
_query("set_and", f"{_CLICK} and on(instance) ({_VIEW} > 1e-4)", _PAIR, "value ; FROM L WHERE EXISTS (SELECT 1 FROM R WHERE R.t = L.t AND R.instance = L.instance AND R.value > 1e-4)", *_BOTH)
_query("set_unless", f"{_CLICK} unless ignoring(event_type) ({_VIEW} > 1e-4)", _PAIR, "value ; FROM L WHERE NOT EXISTS (SELECT 1 FROM R WHERE R.t = L.t AND R.instance = L.instance AND R.value > 1e-4)", *_BOTH)
_query("set_or", f"{_CLICK} or on(instance) {_VIEW}", _PAIR + ", U AS (SELECT * FROM L UNION ALL SELECT * FROM R WHERE NOT EXISTS (SELECT 1 FROM L WHERE R.t = L.t AND R.instance = L.instance))", "value ; FROM U", *_BOTH)
_query("absent", 'absent(value{event_type="click", instance="3"})', _V, "1 ; FROM (SELECT t, 'click' AS event_type, '3' AS instance FROM grid WHERE t NOT IN (SELECT t FROM V WHERE event_type = 'click' AND instance = '3'))", *_BOTH)
_query("scalar", f"{M} - scalar(sum({M}))", f"{_MM}, T AS (SELECT t, sum(value) AS total FROM M GROUP BY t)", "value - total ; FROM M JOIN T USING (t)", *_BOTH)
_query("vector_time", "vector(time())", _GI, "t / 1000 ; FROM grid")
_query("changes", "changes(hits[12h])", f"{_GI}, P AS (SELECT t, event_type, value, lag(value) OVER (PARTITION BY t, event_type ORDER BY ts_ms) AS p FROM grid JOIN C ON ts_ms > t - {HALF_DAY} AND ts_ms <= t)", "count(*) FILTER (value <> p) ; FROM P GROUP BY t, event_type", "event_type")
_query("subquery", "max_over_time(sum_over_time(value[1h])[6h:1h])", f"{_GI}, fine AS (SELECT unnest(generate_series((SELECT min(t) - {SIX} + 3600000 FROM grid), (SELECT max(t) FROM grid), 3600000)) AS f), Q AS (SELECT f, event_type, instance, sum(value) AS value FROM fine JOIN GI ON ts_ms > f - 3600000 AND ts_ms <= f GROUP BY ALL)", f"max(value) ; FROM grid JOIN Q ON f > t - {SIX} AND f <= t GROUP BY t, event_type, instance", *_BOTH)
_query("step_off_width", "stddev_over_time(value[9h])", f"{_GI}, W AS (SELECT t, event_type, instance, stddev_pop(value) AS value FROM grid JOIN GI ON ts_ms > t - 32400000 AND ts_ms <= t GROUP BY ALL)", "value ; FROM W", *_BOTH)
_query("last_keeps_name", 'count by (__name__) (last_over_time(hits[12h]))', f"{_GI}, H AS (SELECT DISTINCT t, event_type FROM grid JOIN C ON ts_ms > t - {HALF_DAY} AND ts_ms <= t), N AS (SELECT t, 'hits' AS __name__, count(*) AS value FROM H GROUP BY t)", "value ; FROM N", "__name__")
_query("lookback", "hits", _H, "value ; FROM H", "event_type")
