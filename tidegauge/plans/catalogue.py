"""One registered query per operator over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import ieee
from tidegauge.functions.timegrid import duration
from tidegauge.operators import buckets, claims, distributions, documents, ranges, series, state, vectors
from tidegauge.registry import register
from tidegauge.sources import events as src

HOUR, SIX, HALF_DAY, DAY = duration("1h"), duration("6h"), duration("12h"), duration("1d")
KEY = ["event_type"]

# --- pieces of oracles ---
S = "S AS (SELECT event_type, user_id % 10 AS instance, epoch_us(ts) // 1000 AS ts_ms, value, event_id FROM events)"
G = f"{S}, G AS (SELECT event_type, ts_ms, max(value) AS value FROM S GROUP BY ALL)"
C = f"{G}, C AS (SELECT event_type, ts_ms, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) % 40 AS DOUBLE) AS value FROM G)"


def end(step: int, ts: str = "ts_ms") -> str:
    return f"CAST((({ts} + {step - 1}) // {step}) * {step} AS BIGINT)"


def left_end(step: int) -> str:
    return f"CAST((ts_ms // {step}) * {step} + {step} AS BIGINT)"


B = f"{S}, B AS (SELECT event_type, {end(HOUR)} AS ts_ms, avg(value) AS avg, min(value) AS min, max(value) AS max, count(value) AS count FROM S GROUP BY ALL)"


def windows(source: str, step: int, width: int) -> str:
    """Brute force: every grid time joined with the samples of its window."""
    return f"grid AS (SELECT unnest(generate_series((SELECT {end(step, 'min(ts_ms)')} FROM {source}), (SELECT max(ts_ms) + {width - 1} FROM {source}), {step})) AS t), W AS (SELECT t, s.* FROM grid JOIN {source} s ON s.ts_ms > t - {width} AND s.ts_ms <= t)"


def rounded(df: DataFrame, *names: str, digits: int = 7) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(F.col(n).cast("double"), digits))
    return df


# --- buckets ---
register("bucket_rollup", f"WITH {B} SELECT event_type, ts_ms, round(avg, 7) AS avg, min, max, count FROM B")(lambda s, d: rounded(src.buckets(s, d, HOUR), "avg"))

_VALUE = {"sample_mean": "sum(avg * count) / sum(count)", "time_mean": "avg(avg)", "sum": "avg(avg)", "max": "max(max)", "min": "min(min)"}
for _kind, _sql in _VALUE.items():
    register(f"rebucket_{'tile_sum' if _kind == 'sum' else _kind}", f"WITH {B} SELECT event_type, {end(SIX)} AS ts_ms, round({_sql}, 7) AS avg, min(min) AS min, max(max) AS max, CAST(sum(count) AS BIGINT) AS count FROM B GROUP BY ALL")(
        lambda s, d, kind=_kind: rounded(buckets.rebucket(src.buckets(s, d, HOUR), KEY, SIX, kind), "avg")
    )

register("lod_envelope", f"WITH {B} SELECT event_type, {end(DAY)} AS ts_ms, min(min) AS min, max(max) AS max FROM B GROUP BY ALL")(lambda s, d: buckets.rebucket(src.buckets(s, d, HOUR), KEY, DAY, "time_mean").select("event_type", "ts_ms", "min", "max"))
register("hourly_means_complete", f"WITH {B}, H AS (SELECT event_type, {end(SIX)} AS ts_ms, sum(avg * count) / sum(count) AS avg, count(*) AS n FROM B GROUP BY ALL) SELECT event_type, ts_ms, round(avg, 7) AS avg FROM H WHERE n = 6")(
    lambda s, d: rounded(src.buckets(s, d, HOUR).groupBy("event_type", F.col("ts_ms")).agg(F.first("avg").alias("avg"), F.first("count").alias("count")).groupBy("event_type", (F.ceil(F.col("ts_ms") / SIX) * SIX).cast("long").alias("ts_ms")).agg((F.sum(F.col("avg") * F.col("count")) / F.sum("count")).alias("avg"), F.count("*").alias("n")).filter("n = 6").drop("n"), "avg")
)

# --- selectors ---
for _name, _where, _sql in (
    ("sel_eq", lambda: F.col("event_type") == "click", "event_type = 'click'"),
    ("sel_neq", lambda: F.col("event_type") != "click", "event_type <> 'click'"),
    ("sel_regex_anchored", lambda: F.col("event_type").rlike("^(?:c.*|vie)$"), "regexp_full_match(event_type, 'c.*|vie')"),
    ("sel_missing_label", lambda: F.coalesce(F.get_json_object("props", "$.absent"), F.lit("")) == "", "coalesce(json_extract_string(props, '$.absent'), '') = ''"),
):
    register(_name, f"SELECT event_id, event_type, value FROM events WHERE {_sql}")(lambda s, d, w=_where: src.table(s, d, "events").filter(w()).select("event_id", "event_type", "value"))

# --- range functions: width twice the step; 1e-9 on variances keeps exact halves from rounding either way ---
_OVER: dict[str, tuple[Callable[[], Column], str]] = {
    "avg_over_time": (lambda: F.avg(F.col("value")), "avg(value)"), "min_over_time": (lambda: F.min(F.col("value")), "min(value)"), "max_over_time": (lambda: F.max(F.col("value")), "max(value)"), "sum_over_time": (lambda: F.sum(F.col("value")), "sum(value)"),
    "count_over_time": (lambda: F.count(F.col("value")).cast("double"), "CAST(count(value) AS DOUBLE)"), "last_over_time": (lambda: F.max_by(F.col("value"), "ts_ms"), "arg_max(value, ts_ms)"), "first_over_time": (lambda: F.min_by(F.col("value"), "ts_ms"), "arg_min(value, ts_ms)"),
    "present_over_time": (lambda: F.max(F.lit(1.0)), "1.0::DOUBLE"), "stddev_over_time": (lambda: F.stddev_pop(F.col("value")), "stddev_pop(value)"), "stdvar_over_time": (lambda: F.var_pop(F.col("value")) + 1e-9, "var_pop(value) + 1e-9"),
    "quantile_over_time": (lambda: F.percentile(F.col("value"), F.lit(0.9)), "quantile_cont(value, 0.9)"), "deriv": (lambda: F.regr_slope(F.col("value"), (F.col("ts_ms") - F.col("t")) / 1000), "regr_slope(value, (ts_ms - t) / 1000.0)"),
    "predict_linear": (lambda: F.regr_intercept(F.col("value"), (F.col("ts_ms") - F.col("t")) / 1000) + 3600 * F.regr_slope(F.col("value"), (F.col("ts_ms") - F.col("t")) / 1000), "regr_intercept(value, (ts_ms - t) / 1000.0) + 3600 * regr_slope(value, (ts_ms - t) / 1000.0)"),
}


def _shift(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("value", F.col("value") + 1e-9) if name == "stdvar_over_time" else df


for _name, (_f, _sql) in _OVER.items():
    _few = "HAVING count(*) >= 2" if _name in ("deriv", "predict_linear") else ""
    register(_name, f"WITH {G}, {windows('G', SIX, HALF_DAY)} SELECT event_type, t, round({_sql}, 7) AS value FROM W GROUP BY event_type, t {_few}")(
        lambda s, d, f=_f, few=bool(_few), name=_name: rounded(_shift(ranges.folded(src.gauge(s, d), KEY, SIX, HALF_DAY, name.removesuffix("_over_time")), name), "value") if name.removesuffix("_over_time") in ranges.TILED else rounded(ranges.over_time(src.gauge(s, d), KEY, SIX, HALF_DAY, value=f(), n=F.count("*")).filter("n >= 2" if few else "n >= 1").drop("n"), "value")
    )
for _name, _back in (("lookback_instant", 0), ("offset_instant", DAY)):
    register(_name, f"WITH {G}, {windows('G', HOUR, 300_000)} SELECT event_type, CAST(t + {_back} AS BIGINT) AS t, arg_max(value, ts_ms) AS value FROM W GROUP BY ALL")(
        lambda s, d, back=_back: ranges.over_time(src.gauge(s, d), KEY, HOUR, 300_000, value=F.max_by("value", "ts_ms")).withColumn("t", F.col("t") + back)
    )

_EXTRA = """, P AS (SELECT *, coalesce(CASE WHEN value < p THEN p END, 0) AS lost FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, t ORDER BY ts_ms) AS p FROM W)),
E AS (SELECT event_type, t, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS b, arg_min(value, ts_ms) AS f, arg_max(value, ts_ms) - arg_min(value, ts_ms) {lost} AS ch FROM P GROUP BY ALL),
D AS (SELECT *, (b - a) / 1000.0 AS sp, (b - a) / 1000.0 / (n - 1) AS av, (a - (t - {w})) / 1000.0 AS d0, (t - b) / 1000.0 AS d1 FROM E WHERE n >= 2),
D2 AS (SELECT *, CASE WHEN d0 >= av * 1.1 THEN av / 2 ELSE d0 END AS x0, CASE WHEN d1 >= av * 1.1 THEN av / 2 ELSE d1 END AS x1 FROM D)
SELECT event_type, t, round(ch * (sp + {x0} + x1) / sp / {per}, 7) AS value FROM D2"""
for _name, _counter, _per in (("rate", True, True), ("increase", True, False), ("delta", False, False)):
    _x0 = "CASE WHEN ch > 0 AND f >= 0 THEN least(x0, sp * f / ch) ELSE x0 END" if _counter else "x0"
    _source = "C" if _counter else "G"
    register(_name, f"WITH {C}, {windows(_source, SIX, HALF_DAY)}" + _EXTRA.format(lost="+ sum(lost)" if _counter else "", w=HALF_DAY, x0=_x0, per=HALF_DAY / 1000 if _per else 1.0))(
        lambda s, d, c=_counter, p=_per: rounded(ranges.extrapolated(src.counter(s, d) if c else src.gauge(s, d), KEY, SIX, HALF_DAY, c, p), "value")
    )
for _name, _resets in (("changes", False), ("resets", True)):
    _cmp = "value < p" if _resets else "value <> p"
    register(_name, f"WITH {C}, {windows('C', SIX, HALF_DAY)}, P AS (SELECT *, lag(value) OVER (PARTITION BY event_type, t ORDER BY ts_ms) AS p FROM W) SELECT event_type, t, CAST(count(*) FILTER ({_cmp}) AS BIGINT) AS value FROM P GROUP BY ALL")(
        lambda s, d, r=_resets: ranges.pairwise(src.counter(s, d), KEY, SIX, HALF_DAY, r)
    )
for _name, _per in (("irate", True), ("idelta", False)):
    _value = "CASE WHEN value < p THEN value ELSE value - p END / ((ts_ms - pt) / 1000.0)" if _per else "value - p"
    register(_name, f"WITH {C}, {windows('C', SIX, HALF_DAY)}, P AS (SELECT *, lag(value) OVER o AS p, lag(ts_ms) OVER o AS pt, row_number() OVER (PARTITION BY event_type, t ORDER BY ts_ms DESC) AS k FROM W WINDOW o AS (PARTITION BY event_type, t ORDER BY ts_ms)) SELECT event_type, t, round({_value}, 7) AS value FROM P WHERE k = 1 AND p IS NOT NULL")(
        lambda s, d, p=_per: rounded(ranges.instant(src.counter(s, d), KEY, SIX, HALF_DAY, p), "value")
    )
register(
    "subquery_max_of_avg",
    f"WITH {G}, {windows('G', HOUR, HOUR)}, Q AS (SELECT event_type, t AS ts_ms, avg(value) AS value FROM W GROUP BY ALL), grid2 AS (SELECT unnest(generate_series((SELECT {end(SIX, 'min(ts_ms)')} FROM Q), (SELECT max(ts_ms) + {SIX - 1} FROM Q), {SIX})) AS t) SELECT event_type, g.t, round(max(value), 7) AS value FROM grid2 g JOIN Q ON ts_ms > g.t - {SIX} AND ts_ms <= g.t GROUP BY ALL",
)(lambda s, d: rounded(ranges.over_time(ranges.over_time(src.gauge(s, d), KEY, HOUR, HOUR, value=F.avg("value")).withColumnRenamed("t", "ts_ms"), KEY, SIX, SIX, value=F.max("value")), "value"))

# --- instant vectors: mean of six hours by event_type and instance ---
X = f"{S}, X AS (SELECT {end(SIX)} AS t, event_type, instance, avg(value) AS value FROM S GROUP BY ALL)"


def vector(s: SparkSession, d: str) -> DataFrame:
    return buckets.rollup(src.samples(s, d), ["event_type", "instance"], SIX).select(F.col("ts_ms").alias("t"), "event_type", "instance", F.col("avg").alias("value"))


for _how, _sql in {"sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(value) AS DOUBLE)", "group": "1.0::DOUBLE", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value) + 1e-9", "quantile": "quantile_cont(value, 0.5)"}.items():
    register(f"agg_{_how}", f"WITH {X} SELECT t, event_type, round({_sql}, 7) AS value FROM X GROUP BY t, event_type")(lambda s, d, h=_how: rounded(vectors.aggregate(vector(s, d), KEY, h).withColumn("value", F.col("value") + (1e-9 if h == "stdvar" else 0.0)), "value"))
register("agg_avg_without", f"WITH {X} SELECT t, instance, round(avg(value), 7) AS value FROM X GROUP BY t, instance")(lambda s, d: rounded(vectors.aggregate(vector(s, d), ["instance"], "avg"), "value"))
for _name, _desc in (("topk", True), ("bottomk", False)):
    register(_name, f"WITH {X} SELECT t, event_type, instance, round(value, 7) AS value FROM X QUALIFY row_number() OVER (PARTITION BY t ORDER BY value {'DESC' if _desc else 'ASC'}, event_type, instance) <= 3")(
        lambda s, d, desc=_desc: rounded(vectors.ranked(vector(s, d), [], 3, desc, ["event_type", "instance"]), "value")
    )


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vector(s, d)
    pick = lambda kind: v.filter(F.col("event_type") == kind).select("t", "instance", "value")
    return pick("click"), pick("view")


_SIDES = f"{X}, L AS (SELECT t, instance, value FROM X WHERE event_type = 'click'), R AS (SELECT t, instance, value FROM X WHERE event_type = 'view')"
for _name, _value, _sql in (
    ("vec_one_to_one_div", lambda: ieee.div(F.col("l"), F.col("r")), "L.value / R.value"),
    ("vec_one_to_one_sub", lambda: F.col("l") - F.col("r"), "L.value - R.value"),
    ("vec_cmp_bool", lambda: (F.col("l") > F.col("r")).cast("double"), "CAST(L.value > R.value AS DOUBLE)"),
):
    register(_name, f"WITH {_SIDES} SELECT t, instance, round({_sql}, 7) AS value FROM L JOIN R USING (t, instance)")(lambda s, d, v=_value: rounded(vectors.match(*sides(s, d), ["instance"], v()), "value"))
register("vec_group_left", f"WITH {X}, T AS (SELECT t, event_type, sum(value) AS total FROM X GROUP BY ALL) SELECT t, event_type, instance, round(value / total, 7) AS value FROM X JOIN T USING (t, event_type)")(
    lambda s, d: rounded(vectors.match(vector(s, d), vectors.aggregate(vector(s, d), KEY, "sum"), KEY, ieee.div(F.col("l"), F.col("r")), many_to_one=True), "value")
)
register("vec_scalar_cmp_filter", f"WITH {X} SELECT t, event_type, instance, round(value, 7) AS value FROM X WHERE value > 50")(lambda s, d: rounded(vector(s, d).filter(F.col("value") > 50), "value"))
register("set_and", f"WITH {_SIDES} SELECT t, instance, round(value, 7) AS value FROM L WHERE EXISTS (SELECT 1 FROM R WHERE R.t = L.t AND R.instance = L.instance)")(lambda s, d: rounded(vectors.set_and(*sides(s, d), ["instance"]), "value"))
register("set_unless", f"WITH {_SIDES} SELECT t, instance, round(value, 7) AS value FROM L WHERE NOT EXISTS (SELECT 1 FROM R WHERE R.t = L.t AND R.instance = L.instance)")(lambda s, d: rounded(vectors.set_unless(*sides(s, d), ["instance"]), "value"))
register("set_or", f"WITH {_SIDES}, U AS (SELECT t, instance, value FROM L UNION ALL SELECT t, instance, value FROM R WHERE NOT EXISTS (SELECT 1 FROM L WHERE R.t = L.t AND R.instance = L.instance)) SELECT t, instance, round(value, 7) AS value FROM U")(lambda s, d: rounded(vectors.set_or(*sides(s, d), ["instance"]), "value"))
register("label_replace", f"WITH {X} SELECT t, regexp_replace(event_type, '^(.).*$', '\\1-kind') AS kind, instance, round(value, 7) AS value FROM X")(
    lambda s, d: rounded(vector(s, d).select("t", F.regexp_replace("event_type", "^(.).*$", "$1-kind").alias("kind"), "instance", "value"), "value")
)
for _name, _value, _sql in (
    ("clamp", lambda: ieee.clamp(F.col("value"), 40.0, 60.0), "least(greatest(value, 40), 60)"),
    ("round_to", lambda: ieee.round_to(F.col("value"), 5.0), "floor(value / 5 + 0.5) * 5"),
    ("math_ln", lambda: ieee.finite(ieee.ln(F.col("value"))), "CASE WHEN value > 0 THEN ln(value) END"),
    ("math_sqrt", lambda: ieee.finite(F.sqrt(F.abs(F.col("value")))), "sqrt(abs(value))"),
    ("math_mod", lambda: ieee.mod(F.col("value"), F.lit(7.0)), "fmod(value, 7)"),
):
    register(_name, f"WITH {X} SELECT t, event_type, instance, round({_sql}, 7) AS value FROM X")(lambda s, d, v=_value: rounded(vector(s, d).withColumn("value", v()), "value"))

_LE = (10, 50, 100, 500)
_LES = ", ".join(f"({e}::DOUBLE)" for e in (*_LE, "'Infinity'"))


def cumulative(s: SparkSession, d: str) -> DataFrame:
    edges = F.array(*[F.lit(float(e)) for e in _LE], F.lit(float("inf")))
    rows = src.samples(s, d).select("event_type", (F.ceil(F.col("ts_ms") / DAY) * DAY).cast("long").alias("t"), "value", F.explode(edges).alias("le"))
    return rows.groupBy("event_type", "t", "le").agg(F.count_if(F.col("value") <= F.col("le")).cast("double").alias("value"))


_CUM = f"{S}, H AS (SELECT event_type, {end(DAY)} AS t, le, CAST(count(*) FILTER (value <= le) AS DOUBLE) AS value FROM S, (VALUES {_LES}) e(le) GROUP BY ALL)"
register(
    "histogram_quantile",
    f"WITH {_CUM}, Q AS (SELECT *, 0.9 * max(value) OVER (PARTITION BY event_type, t) AS rk, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(value) OVER o, 0) AS c0 FROM H WINDOW o AS (PARTITION BY event_type, t ORDER BY le)), K AS (SELECT * FROM Q WHERE value >= rk AND rk > 0), F AS (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY le) AS place FROM K) SELECT event_type, t, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rk - c0) / (value - c0) END, 7) AS value FROM F WHERE place = 1",
)(lambda s, d: rounded(vectors.histogram_quantile(cumulative(s, d), ["event_type", "t"], 0.9), "value"))
register("cumulative_to_buckets", f"WITH {_CUM}, Q AS (SELECT event_type, t, le, value - coalesce(lag(value) OVER (PARTITION BY event_type, t ORDER BY le), 0) AS count FROM H) SELECT event_type, t, CASE WHEN isinf(le) THEN NULL ELSE le END AS bucket_hi, count FROM Q WHERE count > 0")(
    lambda s, d: distributions.cumulative_to_buckets(cumulative(s, d), ["event_type", "t"]).select("event_type", "t", ieee.finite(F.col("bucket_hi")).alias("bucket_hi"), "count")
)

# --- document forms ---
for _name, _by, _aggs, _sql in (
    ("es_rate", KEY, lambda: {"value": F.count("*") / 3600}, "count(*) / 3600.0 AS value"),
    ("es_sum_rate", KEY, lambda: {"value": F.sum("value") / 3600}, "sum(value) / 3600 AS value"),
    ("es_field_rate", ["instance"], lambda: {"value": F.count("value") / 3600}, "count(value) / 3600.0 AS value"),
    ("es_stats", KEY, lambda: {"value": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value")}, "avg(value) AS value, min(value) AS min, max(value) AS max, count(value) AS count"),
    ("es_percentile_exact", KEY, lambda: {"value": F.percentile("value", F.lit(0.95)), "count": F.count("value")}, "quantile_cont(value, 0.95) AS value, count(value) AS count"),
    ("es_composite", ["event_type", "instance"], lambda: {"value": F.sum("value")}, "sum(value) AS value"),
):
    register(_name, f"WITH {S}, A AS (SELECT {', '.join(_by)}, {left_end(HOUR)} AS ts_ms, {_sql} FROM S GROUP BY {', '.join(_by)}, {left_end(HOUR)}) SELECT * REPLACE (round(value, 7) AS value) FROM A")(
        lambda s, d, by=_by, aggs=_aggs: rounded(documents.form(src.samples(s, d), by, HOUR, **aggs()), "value")
    )
register("es_histogram", f"WITH {S} SELECT {left_end(DAY)} AS ts_ms, floor(value / 25) * 25 AS bucket_lo, count(*) AS count FROM S GROUP BY ALL")(lambda s, d: documents.value_histogram(src.samples(s, d), DAY, 25.0))
register("es_range", f"WITH {S} SELECT {left_end(DAY)} AS ts_ms, CASE WHEN value >= 80 THEN 80.0::DOUBLE WHEN value >= 20 THEN 20.0::DOUBLE END AS bucket_lo, count(*) AS count FROM S GROUP BY ALL")(lambda s, d: documents.ranges(src.samples(s, d), DAY, [20.0, 80.0]))
register(
    "es_interior_zero_fill",
    f"WITH {S}, A AS (SELECT event_type, {left_end(HOUR)} AS ts_ms, count(*) / 3600.0 AS value FROM S GROUP BY ALL), E AS (SELECT event_type, unnest(generate_series(min(ts_ms), max(ts_ms), {HOUR})) AS ts_ms FROM A GROUP BY event_type) SELECT event_type, ts_ms, round(coalesce(value, 0), 7) AS value FROM E LEFT JOIN A USING (event_type, ts_ms)",
)(lambda s, d: rounded(documents.interior_zero_fill(documents.form(src.samples(s, d), KEY, HOUR, value=F.count("*") / 3600), KEY, HOUR), "value"))
register(
    "in_flight_avg",
    f"WITH {S}, P AS (SELECT event_type, ts_ms AS a, ts_ms + 60000 + CAST(floor(value) AS BIGINT) * 1000 AS b FROM S), D AS (SELECT event_type, b, a, unnest(generate_series((a // {HOUR}) * {HOUR} + {HOUR}, ((b + {HOUR - 1}) // {HOUR}) * {HOUR}, {HOUR})) AS ts_ms FROM P) SELECT event_type, CAST(ts_ms AS BIGINT) AS ts_ms, round(sum(least(b, ts_ms) - greatest(a, ts_ms - {HOUR})) / {HOUR}, 7) AS avg FROM D GROUP BY ALL HAVING sum(least(b, ts_ms) - greatest(a, ts_ms - {HOUR})) > 0",
)(lambda s, d: rounded(documents.in_flight(src.samples(s, d).select("event_type", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 60000 + F.floor("value") * 1000).alias("end_ms")), KEY, HOUR).filter("avg > 0").select("event_type", "ts_ms", "avg"), "avg"))

# --- distributions ---
DD = f"{S}, DD AS (SELECT event_type, {end(SIX)} AS ts_ms, (ceil(value / 10) * 10 - 10)::DOUBLE AS bucket_lo, (ceil(value / 10) * 10)::DOUBLE AS bucket_hi, CAST(count(*) AS DOUBLE) AS count FROM S GROUP BY ALL)"


def dist(s: SparkSession, d: str) -> DataFrame:
    return distributions.from_samples(src.samples(s, d), KEY, SIX, 10.0)


register("dist_columns", f"WITH {DD} SELECT * FROM DD")(dist)
register("dist_rebucket_time", f"WITH {DD} SELECT event_type, {end(DAY)} AS ts_ms, bucket_lo, bucket_hi, sum(count) AS count FROM DD GROUP BY ALL")(lambda s, d: distributions.rebucket_time(dist(s, d), KEY, DAY))
register("dist_merge_edges", f"WITH {DD} SELECT event_type, ts_ms, floor(bucket_lo / 50) * 50 AS bucket_lo, ceil(bucket_hi / 50) * 50 AS bucket_hi, sum(count) AS count FROM DD GROUP BY ALL")(lambda s, d: distributions.merge_edges(dist(s, d), KEY, 50.0))
_A, _B = 1704500000000, 1705000000000
register("window_histogram", f"WITH {DD} SELECT event_type, bucket_lo, bucket_hi, sum(count) AS count FROM DD WHERE ts_ms > {_A} AND ts_ms - {SIX} < {_B} GROUP BY ALL")(lambda s, d: distributions.window_histogram(dist(s, d), KEY, _A, _B, SIX))
for _name, _x in (("fraction_over_edge", 50.0), ("fraction_over_bounded", 55.0)):
    register(_name, f"WITH {DD}, A AS (SELECT event_type, sum(count) AS n, coalesce(sum(count) FILTER (bucket_lo >= {_x}), 0) AS k, coalesce(sum(count) FILTER (bucket_lo < {_x} AND bucket_hi > {_x}), 0) AS h FROM DD GROUP BY ALL) SELECT event_type, n, round(k / n, 7) AS lo, round((k + h) / n, 7) AS hi FROM A")(
        lambda s, d, x=_x: rounded(distributions.fraction_over(dist(s, d), KEY, x).select("event_type", "n", "lo", "hi"), "lo", "hi")
    )
register("wilson_interval", f"WITH {DD}, A AS (SELECT event_type, sum(count) AS n, sum(count) FILTER (bucket_lo >= 50) / sum(count) AS p, 1.959963984540054 AS z FROM DD GROUP BY ALL) SELECT event_type, round(((p + z*z/(2*n)) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 7) AS wilson_lo, round(((p + z*z/(2*n)) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 7) AS wilson_hi FROM A")(
    lambda s, d: rounded(distributions.fraction_over(dist(s, d), KEY, 50.0).select("event_type", "wilson_lo", "wilson_hi"), "wilson_lo", "wilson_hi")
)
register("quantile_bucket", f"WITH {DD}, A AS (SELECT *, sum(count) OVER (PARTITION BY event_type, ts_ms ORDER BY bucket_hi, bucket_lo) AS acc, sum(count) OVER (PARTITION BY event_type, ts_ms) AS n FROM DD) SELECT event_type, ts_ms, n, bucket_lo, bucket_hi FROM A WHERE acc >= n * 0.5 * (1 - 1e-12) AND n >= 20 QUALIFY row_number() OVER (PARTITION BY event_type, ts_ms ORDER BY acc) = 1")(
    lambda s, d: distributions.quantile_buckets(dist(s, d), ["event_type", "ts_ms"], 0.5)
)
register("cdf", f"WITH {DD}, A AS (SELECT event_type, bucket_hi, sum(count) AS count FROM DD GROUP BY ALL) SELECT event_type, bucket_hi, count, round(sum(count) OVER (PARTITION BY event_type ORDER BY bucket_hi) / sum(count) OVER (PARTITION BY event_type), 7) AS cdf FROM A")(lambda s, d: rounded(distributions.cdf(dist(s, d), KEY), "cdf"))
register("ks_distance", f"WITH {DD}, E AS (SELECT DISTINCT bucket_hi AS e FROM DD WHERE event_type IN ('click', 'view')), A AS (SELECT e, sum(count) FILTER (event_type = 'click' AND bucket_hi <= e) AS x, sum(count) FILTER (event_type = 'view' AND bucket_hi <= e) AS y, sum(count) FILTER (event_type = 'click') AS nx, sum(count) FILTER (event_type = 'view') AS ny FROM E, DD GROUP BY e) SELECT round(max(abs(coalesce(x, 0) / nx - coalesce(y, 0) / ny)), 7) AS distance FROM A")(
    lambda s, d: rounded(distributions.ks_distance(dist(s, d).filter("event_type = 'click'"), dist(s, d).filter("event_type = 'view'")), "distance")
)

# --- bucket states: 2024-01-01 .. 2024-01-30, one failed span ---
_T0, _T1 = 1704067200000, 1704067200000 + 29 * DAY
_FAILED = (_T0 + 10 * HOUR, _T0 + 15 * HOUR)


def states(s: SparkSession, d: str) -> DataFrame:
    return state.presence(src.samples(s, d), KEY, HOUR, _T0, _T1, [_FAILED])


ST = f"""{S}, N AS (SELECT event_type, {end(HOUR)} AS ts_ms, CAST(count(*) AS DOUBLE) AS observed FROM S GROUP BY ALL),
U AS (SELECT event_type, min(ts_ms) AS first, quantile_cont(observed, 0.5) AS usual FROM N GROUP BY ALL),
GR AS (SELECT event_type, first, usual, unnest(generate_series({_T0 + HOUR}, {_T1}, {HOUR})) AS ts_ms FROM U),
Z AS (SELECT event_type, ts_ms, coalesce(observed, 0) AS o, usual, ts_ms > {_FAILED[0]} AND ts_ms - {HOUR} < {_FAILED[1]} AS unk, ts_ms < first AS abs FROM GR LEFT JOIN N USING (event_type, ts_ms)),
Y AS (SELECT event_type, ts_ms, CASE WHEN unk THEN 0 ELSE o END AS observed, CASE WHEN unk OR abs THEN 0 ELSE usual END AS expected,
  CASE WHEN unk THEN 4 WHEN abs THEN 3 WHEN o = 0 THEN 2 WHEN o < usual - (greatest(1, usual * 0.1) + 0.1) THEN 1 ELSE 0 END AS state FROM Z),
ST AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY event_type ORDER BY ts_ms) IN (2, 4) AND state IN (0, 1) THEN 16 ELSE 0 END AS flags FROM Y)"""
register("bucket_state_presence", f"WITH {ST} SELECT event_type, ts_ms, CAST(observed AS DOUBLE) AS observed, CAST(expected AS DOUBLE) AS expected, state, flags FROM ST")(states)
register("post_gap_flags", f"WITH {ST} SELECT event_type, ts_ms FROM ST WHERE flags = 16")(lambda s, d: states(s, d).filter(F.col("flags") == state.POST_GAP).select("event_type", "ts_ms"))
register(
    "state_coarsen",
    f"WITH {ST}, K AS (SELECT event_type, {end(SIX)} AS ts_ms, CAST(coalesce(sum(observed) FILTER (state <> 3), 0) AS DOUBLE) AS observed, CAST(coalesce(sum(expected) FILTER (state <> 3), 0) AS DOUBLE) AS expected, bit_or(flags) AS flags, bool_or(state = 4) AS u, bool_and(state = 3) AS a FROM ST GROUP BY ALL) SELECT event_type, ts_ms, observed, expected, CASE WHEN u THEN 4 WHEN a THEN 3 WHEN observed = 0 AND expected > 0 THEN 2 WHEN observed < expected - (greatest(1, expected * 0.1) + 0.1) THEN 1 ELSE 0 END AS state, flags FROM K",
)(lambda s, d: state.coarsen(states(s, d), KEY, SIX))
register(
    "state_group_merge",
    f"WITH {ST} SELECT ts_ms, count(*) FILTER (state <> 3) AS alive, count(*) FILTER (state IN (0, 1)) AS reporting, CAST(coalesce(sum(observed) FILTER (state <> 3), 0) AS DOUBLE) AS observed, CAST(coalesce(sum(expected) FILTER (state <> 3), 0) AS DOUBLE) AS expected, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (state = 2), '') AS silent FROM ST GROUP BY ts_ms",
)(lambda s, d: state.merge_group(states(s, d), "event_type"))
register("coverage_per_series", f"WITH {ST} SELECT event_type, count(*) FILTER (state = 0) AS ok, count(*) AS buckets, round(sum(observed) / sum(expected), 7) AS share FROM ST GROUP BY ALL")(
    lambda s, d: rounded(states(s, d).groupBy("event_type").agg(F.count_if(F.col("state") == state.OK).alias("ok"), F.count("*").alias("buckets"), (F.sum("observed") / F.sum("expected")).alias("share")), "share")
)

# --- series statistics ---
register("scan_series_stats", f"WITH {C}, L AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms) AS d FROM C) SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS negatives, count(*) FILTER (d > 0) AS increases, count(*) FILTER (d < 0) AS decreases, count(*) FILTER (d = 0) AS constants, CAST(bool_and(value = floor(value)) AS INTEGER) AS integral FROM L GROUP BY ALL")(
    lambda s, d: series.scan(src.counter(s, d), KEY)
)
register("sample_spacing", f"WITH {G}, L AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY event_type ORDER BY ts_ms) AS d FROM G) SELECT event_type, count(*) AS n, quantile_cont(d, 0.5) AS spacing FROM L GROUP BY ALL HAVING count(*) >= 3")(lambda s, d: series.spacing(src.gauge(s, d), KEY))
register("ar1_phi", f"WITH {B}, Q AS (SELECT *, avg - avg(avg) OVER (PARTITION BY event_type) AS x FROM B), L AS (SELECT *, lag(x) OVER o AS p, ts_ms - lag(ts_ms) OVER o AS d FROM Q WINDOW o AS (PARTITION BY event_type ORDER BY ts_ms)) SELECT event_type, round(greatest(-0.99, least(0.99, sum(x * p) / sum(p * p))), 7) AS phi, count(*) AS pairs FROM L WHERE d = {HOUR} GROUP BY event_type")(
    lambda s, d: rounded(series.ar1(src.buckets(s, d, HOUR), KEY, HOUR), "phi")
)
register("robust_sigma_mad", f"WITH {S} SELECT event_type, round(median(value), 7) AS median, round(1.4826 * mad(value), 7) AS sigma FROM S GROUP BY ALL")(lambda s, d: rounded(series.robust_sigma(src.samples(s, d), KEY), "median", "sigma"))
register("hour_of_week_profile", f"WITH {S} SELECT event_type, CAST((ts_ms // {HOUR} + 72) % 168 AS INTEGER) AS hour, count(*) AS n, round(quantile_cont(value, 0.25), 7) AS p25, round(quantile_cont(value, 0.5), 7) AS p50, round(quantile_cont(value, 0.75), 7) AS p75 FROM S GROUP BY ALL")(
    lambda s, d: rounded(series.hour_of_week(src.samples(s, d), KEY), "p25", "p50", "p75")
)
register("fleet_spread", f"WITH {B}, A AS (SELECT ts_ms, count(avg) AS n, min(avg) AS lo, max(avg) AS hi, quantile_cont(avg, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p FROM B GROUP BY ts_ms) SELECT ts_ms, n, round(lo, 7) AS lo, round(hi, 7) AS hi, CASE WHEN n >= 5 THEN round(p[1], 7) END AS q10, CASE WHEN n >= 3 THEN round(p[2], 7) END AS q25, round(p[3], 7) AS q50, CASE WHEN n >= 3 THEN round(p[4], 7) END AS q75, CASE WHEN n >= 5 THEN round(p[5], 7) END AS q90 FROM A")(
    lambda s, d: rounded(series.fleet_spread(src.buckets(s, d, HOUR)), "lo", "hi", "q10", "q25", "q50", "q75", "q90")
)
register(
    "series_rank_others",
    f"WITH {B}, M AS (SELECT *, quantile_cont(avg, 0.5) OVER (PARTITION BY ts_ms) AS mid FROM B), K AS (SELECT event_type, row_number() OVER (ORDER BY max(abs(avg - mid)) DESC, max(max) DESC, event_type) AS place FROM M GROUP BY event_type) SELECT CASE WHEN place <= 2 THEN event_type ELSE 'others' END AS series, ts_ms, round(quantile_cont(avg, 0.5), 7) AS avg, min(min) AS min, max(max) AS max, CAST(sum(count) AS BIGINT) AS count, count(*) AS reporting FROM B JOIN K USING (event_type) GROUP BY ALL",
)(lambda s, d: rounded(series.rank_and_fold(src.buckets(s, d, HOUR), "event_type", 2), "avg"))
register(
    "lomb_scargle_power",
    f"WITH {S}, A AS (SELECT event_type, p AS period_ms, avg(value) AS y, avg(cos(w)) AS c, avg(sin(w)) AS s, avg(value * value) AS yy, avg(value * cos(w)) AS yc, avg(value * sin(w)) AS ys, avg(cos(w) * cos(w)) AS cc, avg(sin(w) * sin(w)) AS ss, avg(cos(w) * sin(w)) AS cs FROM (SELECT *, ts_ms * (2 * pi()) / p AS w FROM S, (VALUES ({DAY}), ({7 * DAY})) q(p)) GROUP BY ALL), X AS (SELECT event_type, period_ms, yy - y*y AS vy, yc - y*c AS vc, ys - y*s AS vs, cc - c*c AS c2, ss - s*s AS s2, cs - c*s AS x FROM A) SELECT event_type, CAST(period_ms AS BIGINT) AS period_ms, round((s2*vc*vc + c2*vs*vs - 2*x*vc*vs) / (vy * (c2*s2 - x*x)), 7) AS power FROM X",
)(lambda s, d: rounded(series.lomb_scargle(src.samples(s, d), KEY, [DAY, 7 * DAY]), "power"))
register(
    "gaussian_lowpass",
    f"WITH {B}, D AS (SELECT event_type, ts_ms + k * {HOUR} AS ts_ms, avg, exp(-(k * k) / 8.0) AS w FROM B, (SELECT unnest(generate_series(-6, 6)) AS k)), Q AS (SELECT event_type, ts_ms, sum(w * avg) / sum(w) AS smooth FROM D GROUP BY ALL) SELECT event_type, ts_ms, round(smooth, 7) AS smooth FROM B JOIN Q USING (event_type, ts_ms)",
)(lambda s, d: rounded(series.gaussian_lowpass(src.buckets(s, d, HOUR), KEY, HOUR, 2), "smooth"))
register("segments", f"WITH {B}, I AS (SELECT *, ts_ms - row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) * {HOUR} AS i FROM B) SELECT event_type, min(ts_ms) AS start, max(ts_ms) AS \"end\", count(*) AS n FROM I GROUP BY event_type, i")(lambda s, d: series.segments(src.buckets(s, d, HOUR), KEY, HOUR))
_RULE = "count(*) OVER w{k} = {k} AND (sum(CAST(z > {b} AS INT)) OVER w{k} >= {n} OR sum(CAST(-z > {b} AS INT)) OVER w{k} >= {n})"
_RULES = ", ".join(f"CAST({_RULE.format(k=k, n=n, b=b)} AS INTEGER) AS {r}" for r, k, n, b in (("r2", 3, 2, 2), ("r3", 5, 4, 1), ("r4", 8, 8, 0)))
_WINDOWS = ", ".join(f"w{k} AS (PARTITION BY event_type ORDER BY ts_ms RANGE BETWEEN {(k - 1) * HOUR} PRECEDING AND CURRENT ROW)" for k in (3, 5, 8))


def standardised(s: SparkSession, d: str) -> DataFrame:
    rows = src.buckets(s, d, HOUR)
    m = rows.groupBy("event_type").agg(F.percentile("avg", F.lit(0.5)).alias("m"))
    return rows.join(m, "event_type").withColumn("z", (F.col("avg") - F.col("m")) / 20)


register("run_rules_spc", f"WITH {B}, Z AS (SELECT event_type, ts_ms, (avg - quantile_cont(avg, 0.5) OVER (PARTITION BY event_type)) / 20 AS z FROM B) SELECT event_type, ts_ms, CAST(abs(z) > 3 AS INTEGER) AS r1, {_RULES} FROM Z WINDOW {_WINDOWS}")(lambda s, d: series.run_rules(standardised(s, d), KEY, HOUR))

# --- catalog: claims made from events (metric = user, field = event_type) ---
_ORIGIN = "list_extract(['user', 'agent', 'stats', 'context', 'pack', 'metadata', 'rule'], CAST(event_id % 7 + 1 AS INT))"
CL = f"CL AS (SELECT user_id % 50 AS metric, event_type AS field, {_ORIGIN} AS origin, event_id % 7 AS strength, CAST(floor(value) AS BIGINT) AS value, (event_id % 10) / 10.0 AS confidence, epoch_us(ts) // 1000 AS ts_ms FROM events)"


def claim_rows(s: SparkSession, d: str) -> DataFrame:
    origin = F.element_at(F.array(*[F.lit(o) for o in claims.ORIGINS]), (F.col("event_id") % 7 + 1).cast("int"))
    return src.table(s, d, "events").select((F.col("user_id") % 50).alias("metric"), F.col("event_type").alias("field"), origin.alias("origin"), F.floor("value").alias("value"), ((F.col("event_id") % 10) / 10).alias("confidence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


register("claims_winner", f"WITH {CL} SELECT metric, field, origin, value, round(confidence, 7) AS confidence, ts_ms FROM CL QUALIFY row_number() OVER (PARTITION BY metric, field ORDER BY strength, confidence DESC, ts_ms DESC, value DESC) = 1")(lambda s, d: rounded(claims.winners(claim_rows(s, d)), "confidence"))
register("claims_conflicts", f'WITH {CL} SELECT metric, field, count(DISTINCT value) AS "values" FROM CL GROUP BY ALL HAVING count(DISTINCT value) > 1')(lambda s, d: claims.conflicts(claim_rows(s, d)))
