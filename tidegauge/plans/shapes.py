"""Queries over sequences, summaries, joins and distributions, with the SQL that must give the same rows. Where the events
hold no case of a rule, the rows stand in VALUES that both sides read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import buckets, distributions, sequences, series, state, summaries, vectors
from tidegauge.functions import ieee
from tidegauge.plans.catalogue import B, C, DAY, DD, G, HOUR, KEY, S, SIX, cumulative, dist, end, rounded
from tidegauge.registry import register
from tidegauge.sources import events as src

_ZERO = 1704067200000


def hourly(s: SparkSession, d: str) -> DataFrame:
    return src.buckets(s, d, HOUR)


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({columns})")


def special(x: str) -> str:
    """SQL of both sides: a double as text, so that NaN and infinities compare as such."""
    return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN {x} = CAST('Infinity' AS DOUBLE) THEN '+Inf' WHEN {x} = CAST('-Infinity' AS DOUBLE) THEN '-Inf' ELSE CAST(round({x}, 6) AS VARCHAR(30)) END"


# --- sequences over hourly buckets ---
_Z = f"{B}, Z AS (SELECT event_type, ts_ms, round((avg - quantile_cont(avg, 0.5) OVER (PARTITION BY event_type)) / 20 + 1e-9, 6) AS z FROM B)"


def standard(s: SparkSession, d: str) -> DataFrame:
    rows = hourly(s, d)
    mid = rows.groupBy("event_type").agg(F.percentile("avg", F.lit(0.5)).alias("m"))
    return rows.join(mid, "event_type").select("event_type", "ts_ms", F.round((F.col("avg") - F.col("m")) / 20 + 1e-9, 6).alias("z"))


_GAP = f"(greatest(0, coalesce((ts_ms - lag(ts_ms) OVER o) / {HOUR} - 1, 0)))::DOUBLE"
_SEQ = f"{_Z}, Q AS (SELECT event_type, ts_ms, z::DOUBLE AS z, {_GAP} AS gap, row_number() OVER o AS i FROM Z WINDOW o AS (PARTITION BY event_type ORDER BY ts_ms))"
_STEP_E = "power(0.8, Q.gap) * 0.8 * R.e + 0.2 * Q.z"
register(
    "ewma_signals",
    f"WITH RECURSIVE {_SEQ}, R AS (SELECT event_type, i, ts_ms, CASE WHEN abs(0.2 * z) > 1 THEN 0 ELSE 0.2 * z END AS e, abs(0.2 * z) > 1 AS hit FROM Q WHERE i = 1 UNION ALL SELECT Q.event_type, Q.i, Q.ts_ms, CASE WHEN abs({_STEP_E}) > 1 THEN 0 ELSE {_STEP_E} END, abs({_STEP_E}) > 1 FROM R JOIN Q ON Q.event_type = R.event_type AND Q.i = R.i + 1) SELECT event_type, ts_ms FROM R WHERE hit",
)(lambda s, d: sequences.ewma_signals(standard(s, d), KEY, HOUR))
_UP, _DOWN = "greatest(0, greatest(0, R.u - Q.gap * 0.5) + Q.z - 0.5)", "greatest(0, greatest(0, R.w - Q.gap * 0.5) - Q.z - 0.5)"
CUSUM = f"WITH RECURSIVE {_SEQ}, R AS (SELECT event_type, i, ts_ms, greatest(0, z - 0.5)::DOUBLE AS a, greatest(0, -z - 0.5)::DOUBLE AS b, CASE WHEN greatest(z, -z) - 0.5 > 5 THEN 0 ELSE greatest(0, z - 0.5) END::DOUBLE AS u, CASE WHEN greatest(z, -z) - 0.5 > 5 THEN 0 ELSE greatest(0, -z - 0.5) END::DOUBLE AS w FROM Q WHERE i = 1 UNION ALL SELECT Q.event_type, Q.i, Q.ts_ms, {_UP}, {_DOWN}, CASE WHEN greatest({_UP}, {_DOWN}) > 5 THEN 0 ELSE {_UP} END, CASE WHEN greatest({_UP}, {_DOWN}) > 5 THEN 0 ELSE {_DOWN} END FROM R JOIN Q ON Q.event_type = R.event_type AND Q.i = R.i + 1) SELECT event_type, ts_ms, round(a, 6) AS up, round(b, 6) AS down FROM R WHERE greatest(a, b) > 5"
register("cusum_signals", CUSUM)(lambda s, d: rounded(sequences.cusum_signals(standard(s, d), KEY, HOUR), "up", "down", digits=6))
register(
    "cusum_paths",
    f"WITH RECURSIVE {_SEQ}, R AS (SELECT event_type, i, ts_ms, greatest(0, z - 0.5)::DOUBLE AS u, greatest(0, -z - 0.5)::DOUBLE AS w FROM Q WHERE i = 1 UNION ALL SELECT Q.event_type, Q.i, Q.ts_ms, {_UP}, {_DOWN} FROM R JOIN Q ON Q.event_type = R.event_type AND Q.i = R.i + 1) SELECT event_type, ts_ms, round(u, 6) AS up, round(w, 6) AS down FROM R",
)(lambda s, d: rounded(sequences.cusum_paths(standard(s, d), KEY, HOUR), "up", "down", digits=6))
_T = f"{B}, T AS (SELECT event_type, ts_ms, CASE WHEN count >= 2 THEN avg END AS v FROM B)"


def gappy(s: SparkSession, d: str) -> DataFrame:
    """Hourly means, unknown for hours with fewer than two samples."""
    return hourly(s, d).select("event_type", "ts_ms", F.when(F.col("count") >= 2, F.col("avg")).alias("v"))


register("fill_both_ways", f"WITH {_T} SELECT event_type, ts_ms, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts_ms ROWS UNBOUNDED PRECEDING), 7) AS filled_back, round(first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 7) AS filled_ahead FROM T")(
    lambda s, d: rounded(sequences.filled(gappy(s, d), KEY, "v").drop("v"), "filled_back", "filled_ahead")
)
register("rolling_median", f"WITH {_T} SELECT event_type, ts_ms, round(CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, 0.5) OVER w END, 7) AS median FROM T WINDOW w AS (PARTITION BY event_type ORDER BY ts_ms ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")(
    lambda s, d: rounded(sequences.rolling_median(gappy(s, d), KEY, "v", 5).drop("v"), "median")
)
register("loo_median", f"WITH {B} SELECT a.event_type, a.ts_ms, round((SELECT quantile_cont(b.avg, 0.5) FROM B b WHERE b.ts_ms = a.ts_ms AND b.event_type <> a.event_type), 7) AS others FROM B a")(
    lambda s, d: rounded(sequences.loo_median(hourly(s, d).select("event_type", "ts_ms", "avg"), ["ts_ms"], "avg").drop("avg"), "others")
)
register("near_bound_runs", f"WITH {B}, H AS (SELECT event_type, ts_ms, ts_ms - row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) * {HOUR} AS i FROM B WHERE avg >= 0.9 * 55) SELECT event_type, min(ts_ms) AS start, max(ts_ms) AS \"end\", count(*) AS n FROM H GROUP BY event_type, i HAVING count(*) >= 3")(
    lambda s, d: sequences.near_bound(hourly(s, d), KEY, HOUR, "avg", 55.0)
)
register("block_sums", f"WITH {_T}, F AS (SELECT *, min(ts_ms) OVER (PARTITION BY event_type) AS f FROM T) SELECT event_type, CAST((ts_ms - f) // {4 * HOUR} AS BIGINT) AS block, round(CASE WHEN count(v) = 4 THEN sum(v) END, 7) AS total FROM F GROUP BY ALL")(
    lambda s, d: rounded(sequences.block_sums(gappy(s, d), KEY, HOUR, "v", 4), "total")
)
register("cycle_join", f"WITH {B} SELECT b.event_type, b.ts_ms, round(b.avg, 7) AS avg, round(x.avg, 7) AS shift_1, round(y.avg, 7) AS shift_2 FROM B b LEFT JOIN B x ON x.event_type = b.event_type AND x.ts_ms = b.ts_ms - {DAY} LEFT JOIN B y ON y.event_type = b.event_type AND y.ts_ms = b.ts_ms - {2 * DAY}")(
    lambda s, d: rounded(sequences.cycles(hourly(s, d), KEY, "avg", DAY, 2), "avg", "shift_1", "shift_2")
)
register("index_to_window", f"WITH {B}, K AS (SELECT event_type, sum(avg * count) / sum(count) AS base FROM B WHERE ts_ms > {_ZERO} AND ts_ms <= {_ZERO + 3 * DAY} GROUP BY event_type) SELECT event_type, ts_ms, round(avg / base * 100, 7) AS index FROM B JOIN K USING (event_type) WHERE base > 0")(
    lambda s, d: rounded(sequences.index_to(hourly(s, d), KEY, "avg", _ZERO, _ZERO + 3 * DAY).select("event_type", "ts_ms", "index"), "index")
)
register("fill_empty_tiles", f"WITH {_T} SELECT event_type, ts_ms, round(CASE WHEN v IS NULL AND coalesce(CASE WHEN lag(ts_ms) OVER o = ts_ms - {HOUR} THEN lag(v) OVER o END, CASE WHEN lead(ts_ms) OVER o = ts_ms + {HOUR} THEN lead(v) OVER o END) IS NOT NULL THEN 0 ELSE v END, 7) AS filled FROM T WINDOW o AS (PARTITION BY event_type ORDER BY ts_ms)")(
    lambda s, d: rounded(sequences.fill_empty_tiles(gappy(s, d), KEY, HOUR, "v").drop("v"), "filled")
)
_I = f"{S}, I AS (SELECT event_type, instance, {end(SIX)} AS ts_ms, CAST(count(*) AS DOUBLE) AS value FROM S GROUP BY ALL)"


def counted(s: SparkSession, d: str) -> DataFrame:
    rows = buckets.rollup(src.samples(s, d), ["event_type", "instance"], SIX)
    return rows.select("event_type", "instance", "ts_ms", F.col("count").cast("double").alias("value"))


register("born_counters", f"WITH {_I}, L AS (SELECT event_type, instance, min(ts_ms) AS a, max(ts_ms) AS b FROM I GROUP BY ALL), X AS (SELECT DISTINCT event_type, ts_ms FROM I) SELECT event_type, instance, ts_ms, value, FALSE AS filled FROM I UNION ALL SELECT event_type, instance, ts_ms, 0, TRUE FROM L JOIN X USING (event_type) WHERE ts_ms < a OR ts_ms > b")(
    lambda s, d: sequences.born(counted(s, d), ["event_type", "instance"], KEY, counted(s, d).select("ts_ms").distinct())
)
register("sibling_counts", f"WITH {_I} SELECT event_type, instance, ts_ms, value, sum(value) OVER (PARTITION BY event_type, ts_ms) - value AS siblings FROM I")(lambda s, d: sequences.sibling_counts(counted(s, d), KEY))
register("ratio_on_denominator", f"WITH {_I}, N AS (SELECT ts_ms, instance, value FROM I WHERE event_type = 'click'), D AS (SELECT ts_ms, instance, sum(value) AS value FROM I GROUP BY ALL) SELECT instance, ts_ms, round(coalesce(N.value, 0) / D.value, 7) AS value FROM D LEFT JOIN N USING (ts_ms, instance)")(
    lambda s, d: rounded(sequences.ratio(counted(s, d).filter("event_type = 'click'"), counted(s, d).groupBy("instance", "ts_ms").agg(F.sum("value").alias("value")), ["instance"]), "value")
)
_SPANS = f"({_ZERO + 5 * HOUR}, {_ZERO + 7 * HOUR}), ({_ZERO + 6 * HOUR + 1000}, {_ZERO + 9 * HOUR + 1}), ({_ZERO + 30 * HOUR}, {_ZERO + 30 * HOUR})"
register("failed_spans", f"WITH {B}, P AS (SELECT * FROM (VALUES {_SPANS}) v(a, b) WHERE b > a) SELECT event_type, ts_ms, EXISTS (SELECT 1 FROM P WHERE ts_ms > a AND ts_ms - {HOUR} < b) AS failed FROM B")(
    lambda s, d: sequences.in_spans(hourly(s, d).select("event_type", "ts_ms"), values(s, _SPANS, "a, b"), HOUR)
)

# --- summaries ---
register("range_stats", f"WITH {S}, P AS (SELECT event_type, median(value) AS m FROM S GROUP BY ALL) SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.005), 7) AS p005, round(quantile_cont(value, 0.25), 7) AS p25, round(median(value), 7) AS p50, round(quantile_cont(value, 0.75), 7) AS p75, round(quantile_cont(value, 0.995), 7) AS p995, max(value) AS greatest, round(median(abs(value - m)), 7) AS mad FROM S JOIN P USING (event_type) GROUP BY event_type")(
    lambda s, d: rounded(summaries.range_stats(src.samples(s, d), KEY, "value"), "p005", "p25", "p50", "p75", "p995", "mad")
)
register("value_stats", f"WITH {B}, V AS (SELECT unnest([avg, min, max]) AS v FROM B) SELECT count(v) AS n, round(min(v), 7) AS low, round(max(v), 7) AS high FROM V")(lambda s, d: rounded(summaries.value_stats(hourly(s, d), ["avg", "min", "max"]), "low", "high"))
_RANK = "greatest(1, least(n, {f}(n * {q} {s} 1.959963984540054 * sqrt(n * {v})) {p}))"
_CR = ", ".join(
    f"quantile_cont(value, {q}) AS {a}, max(value) FILTER (r = {_RANK.format(f='floor', q=q, s='-', v=q * (1 - q), p='')}) AS {a}_lo, max(value) FILTER (r = {_RANK.format(f='ceil', q=q, s='+', v=q * (1 - q), p='+ 1')}) AS {a}_hi" for a, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))
)
register("characteristic_range", f"WITH {S}, R AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM S) SELECT event_type, count(*) AS n, {_CR} FROM R GROUP BY event_type")(lambda s, d: summaries.characteristic_range(src.samples(s, d), KEY, "value"))
_SCAN = f"{C}, L AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms) AS d FROM C), N AS (SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS neg, count(*) FILTER (d > 0) AS inc, count(*) FILTER (d < 0) AS dec FROM L GROUP BY ALL), J AS (SELECT event_type, n, CASE WHEN inc = 0 AND dec = 0 THEN 'constant' WHEN neg = 0 AND inc > 0 AND dec / greatest(inc + dec, 1) <= 0.05 THEN 'counter' ELSE 'gauge' END AS verdict FROM N)"
register("sample_verdict", f"WITH {_SCAN} SELECT event_type, n, verdict FROM J")(lambda s, d: summaries.kind_of(series.scan(src.counter(s, d), KEY)).select("event_type", "n", "verdict"))
register("pooled_verdict", f"WITH {_SCAN} SELECT count(*) AS series, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(DISTINCT verdict) FILTER (verdict <> 'constant') = 0 THEN 'constant' WHEN count(DISTINCT verdict) FILTER (verdict <> 'constant') = 1 THEN max(verdict) FILTER (verdict <> 'constant') ELSE 'undetermined' END AS verdict FROM J")(
    lambda s, d: summaries.pool_kinds(summaries.kind_of(series.scan(src.counter(s, d), KEY)))
)
register("dataset_summary", f"WITH {B} SELECT event_type, min(ts_ms) AS first, max(ts_ms) AS last, count(avg) AS buckets, round(avg(avg), 7) AS mean, min(min) AS low, max(max) AS high, round(arg_max(avg, ts_ms), 7) AS latest, CAST(sum(count) AS BIGINT) AS samples, round(count(avg) / ((max(ts_ms) - min(ts_ms)) / {HOUR} + 1), 7) AS coverage FROM B GROUP BY ALL")(
    lambda s, d: rounded(summaries.dataset_summary(hourly(s, d), KEY, HOUR), "mean", "latest", "coverage")
)
register("attach_counts", f"WITH {B} SELECT b.event_type, b.ts_ms, round(b.avg, 7) AS avg, CAST(coalesce(x.count, 0) AS BIGINT) AS n FROM B b LEFT JOIN (SELECT * FROM B WHERE count >= 2) x USING (event_type, ts_ms)")(
    lambda s, d: rounded(summaries.attach_counts(hourly(s, d).select("event_type", "ts_ms", "avg"), hourly(s, d).filter("count >= 2").withColumnRenamed("count", "n"), KEY), "avg")
)
_MB = "(1, 1.0), (1, 2.0), (1, 5.0), (1, 9.0), (2, 4.0), (2, 6.0), (3, 7.0)"
register("fleet_missing_bounds", "SELECT * FROM (VALUES (1, 4, '2.0', '5.0'), (2, 2, '-Inf', '+Inf'), (3, 1, '-Inf', '+Inf')) v(ts_ms, reporting, lo_50, hi_50)")(
    lambda s, d: summaries.missing_bounds(values(s, _MB, "ts_ms, avg").withColumn("avg", F.col("avg").cast("double")), 5, "avg", (0.5,)).selectExpr("ts_ms", "reporting", f"{special('lo_50')} AS lo_50", f"{special('hi_50')} AS hi_50")
)
register("distinct_series", f"WITH {S} SELECT count(DISTINCT event_type || '/' || instance) AS series, count(DISTINCT event_type) AS types FROM S")(lambda s, d: src.samples(s, d).agg(F.count_distinct("event_type", "instance").alias("series"), F.count_distinct("event_type").alias("types")))
register("page", f"WITH {B} SELECT event_type, ts_ms, count FROM B ORDER BY count DESC, event_type, ts_ms LIMIT 20 OFFSET 40")(lambda s, d: summaries.page(hourly(s, d), [F.desc("count"), F.col("event_type"), F.col("ts_ms")], 20, 2).select("event_type", "ts_ms", "count"))
register("set_union", f"WITH {S} SELECT event_type AS name FROM S WHERE value > 90 UNION SELECT event_type FROM S WHERE value < 10")(
    lambda s, d: src.samples(s, d).filter("value > 90").select(F.col("event_type").alias("name")).union(src.samples(s, d).filter("value < 10").select("event_type")).distinct()
)
register("set_concat", f"WITH {B} SELECT 'low' AS part, event_type, ts_ms FROM B WHERE avg < 30 UNION ALL SELECT 'high', event_type, ts_ms FROM B WHERE avg > 70")(
    lambda s, d: hourly(s, d).filter("avg < 30").select(F.lit("low").alias("part"), "event_type", "ts_ms").unionByName(hourly(s, d).filter("avg > 70").select(F.lit("high").alias("part"), "event_type", "ts_ms"))
)
register("join_exists", f"WITH {B} SELECT event_type, ts_ms FROM B b WHERE EXISTS (SELECT 1 FROM B x WHERE x.ts_ms = b.ts_ms AND x.event_type = 'view' AND x.avg > 60) AND event_type IN (SELECT event_type FROM B WHERE count > 5)")(
    lambda s, d: hourly(s, d).join(hourly(s, d).filter("event_type = 'view' AND avg > 60").select("ts_ms"), "ts_ms", "left_semi").join(hourly(s, d).filter("count > 5").select("event_type"), "event_type", "left_semi").select("event_type", "ts_ms")
)
_OU = "(1, 2, 'b'), (1, 1, 'c'), (1, 3, 'c'), (2, 1, 'a'), (2, 2, 'a')"
register("ordered_unique", f"WITH v(k, o, c) AS (VALUES {_OU}), F AS (SELECT k, c, min(o) AS o FROM v GROUP BY ALL) SELECT k, string_agg(c, ',' ORDER BY o) AS caveats FROM F GROUP BY k")(
    lambda s, d: summaries.ordered_unique(values(s, _OU, "k, o, c").withColumn("caveats", F.array("c")), ["k"], "o", "caveats").select("k", F.array_join("caveats", ",").alias("caveats"))
)

# --- distributions ---
_CQ = ", ".join(f"(SELECT min_by(x.bucket_{side}, x.acc) FROM A x WHERE x.event_type = A.event_type AND x.ts_ms = A.ts_ms AND x.acc >= x.n * {q} * (1 - 1e-12) AND x.n >= {10 / (1 - q)}) AS {side}_{round(q * 100)}" for q in (0.5, 0.9) for side in ("lo", "hi"))
register("column_quantiles", f"WITH {DD}, A AS (SELECT *, sum(count) OVER (PARTITION BY event_type, ts_ms ORDER BY bucket_hi, bucket_lo) AS acc, sum(count) OVER (PARTITION BY event_type, ts_ms) AS n FROM DD) SELECT DISTINCT event_type, ts_ms, n, {_CQ} FROM A")(
    lambda s, d: distributions.column_quantiles(dist(s, d), ["event_type", "ts_ms"], (0.5, 0.9))
)
register("pooled_window", f"WITH {DD} SELECT bucket_lo, bucket_hi, sum(count) AS count FROM DD GROUP BY ALL")(lambda s, d: distributions.pooled(dist(s, d)))
register("merge_values_classic", f"WITH {DD}, E AS (SELECT event_type, bucket_lo, bucket_hi, row_number() OVER (PARTITION BY event_type ORDER BY bucket_hi) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type, bucket_lo, bucket_hi FROM DD)), P AS (SELECT *, floor(place / ceil(n / 6)) AS g FROM E), M AS (SELECT event_type, g, min(bucket_lo) AS lo, max(bucket_hi) AS hi FROM P GROUP BY ALL) SELECT event_type, ts_ms, lo AS bucket_lo, hi AS bucket_hi, sum(count) AS count FROM DD JOIN P USING (event_type, bucket_lo, bucket_hi) JOIN M USING (event_type, g) GROUP BY ALL")(
    lambda s, d: distributions.merge_values(dist(s, d), KEY, "classic", 6)
)
_NATIVE = "(1, 1.0, 2.0, 3.0), (1, 2.0, 4.0, 4.0), (1, 4.0, 8.0, 5.0), (1, 8.0, 16.0, 6.0), (2, 1.0, 2.0, 1.0), (2, 16.0, 32.0, 7.0)"


def native(s: SparkSession) -> DataFrame:
    return values(s, _NATIVE, "ts_ms, bucket_lo, bucket_hi, count").select(F.lit("x").alias("k"), "ts_ms", *[F.col(c).cast("double").alias(c) for c in ("bucket_lo", "bucket_hi", "count")])


register("merge_values_native", "SELECT 'x' AS k, * FROM (VALUES (1, 1.0::DOUBLE, 4.0::DOUBLE, 7.0::DOUBLE), (1, 4.0, 16.0, 11.0), (2, 1.0, 4.0, 1.0), (2, 16.0, 32.0, 7.0)) v(ts_ms, bucket_lo, bucket_hi, count)")(
    lambda s, d: distributions.merge_values(native(s), ["k"], "native", 3)
)
register("native_schema", "SELECT 'x' AS k, 0 AS schema")(lambda s, d: distributions.native_schema(native(s), ["k"]))
register("common_edges", f"WITH {DD}, E AS (SELECT DISTINCT unnest([bucket_lo, bucket_hi]) AS edge FROM DD), W AS (SELECT DISTINCT bucket_lo, bucket_hi FROM DD UNION SELECT DISTINCT floor(bucket_lo / 30) * 30, floor(bucket_lo / 30) * 30 + 30 FROM DD WHERE event_type = 'view') SELECT edge FROM E WHERE NOT EXISTS (SELECT 1 FROM W WHERE bucket_lo < edge AND edge < bucket_hi)")(
    lambda s, d: distributions.common_edges(dist(s, d).unionByName(distributions.merge_edges(dist(s, d).filter("event_type = 'view'"), KEY, 30.0)), KEY).join(dist(s, d).select(F.explode(F.array("bucket_lo", "bucket_hi")).alias("edge")).distinct(), "edge", "left_semi")
)
register("snap_edge", f"WITH {DD}, E AS (SELECT DISTINCT bucket_hi AS edge FROM DD WHERE bucket_hi > 0) SELECT edge FROM E ORDER BY abs(ln(edge / 33)), edge LIMIT 1")(lambda s, d: distributions.snap(dist(s, d).select(F.col("bucket_hi").alias("edge")).distinct(), 33.0))
register("share_threshold", f"WITH {DD}, E AS (SELECT bucket_hi, sum(count) AS c FROM DD GROUP BY ALL), A AS (SELECT bucket_hi AS edge, sum(c) OVER () - sum(c) OVER (ORDER BY bucket_hi) AS above, sum(c) OVER () AS n FROM E) SELECT edge, round(above / n, 7) AS share, above FROM A WHERE above >= 20 ORDER BY abs(above / n - 0.05), edge LIMIT 1")(
    lambda s, d: rounded(distributions.threshold(dist(s, d), 0.05), "share")
)
register("ccdf", f"WITH {DD}, A AS (SELECT event_type, bucket_hi, sum(count) AS count FROM DD GROUP BY ALL) SELECT event_type, bucket_hi, round(1 - sum(count) OVER (PARTITION BY event_type ORDER BY bucket_hi) / sum(count) OVER (PARTITION BY event_type), 7) AS ccdf FROM A")(
    lambda s, d: rounded(distributions.survival(dist(s, d), KEY), "ccdf")
)
register("density", f"WITH {DD} SELECT event_type, ts_ms, bucket_lo, bucket_hi, round(count / (sum(count) OVER (PARTITION BY event_type, ts_ms) * (bucket_hi - bucket_lo)), 7) AS density FROM DD")(
    lambda s, d: rounded(distributions.density(dist(s, d), ["event_type", "ts_ms"]).drop("count"), "density")
)


def _box(kind: str, name: str) -> str:
    return f"{name} AS (SELECT q, bucket_lo AS {name}_lo, bucket_hi AS {name}_hi FROM (SELECT bucket_lo, bucket_hi, sum(count) OVER (ORDER BY bucket_hi) - count AS low, sum(count) OVER (ORDER BY bucket_hi) AS high, sum(count) OVER () AS n FROM (SELECT bucket_lo, bucket_hi, sum(count) AS count FROM DD WHERE event_type = '{kind}' GROUP BY ALL)), (SELECT unnest(generate_series(1, 9)) AS q) WHERE low < n * q / 10 * (1 - 1e-12) AND n * q / 10 * (1 - 1e-12) <= high)"


register("qq_boxes", f"WITH {DD}, {_box('click', 'a')}, {_box('view', 'b')} SELECT q / 10 AS q, a_lo, a_hi, b_lo, b_hi FROM a JOIN b USING (q)")(
    lambda s, d: distributions.qq(dist(s, d).filter("event_type = 'click'"), dist(s, d).filter("event_type = 'view'"), 10)
)
register("sample_bins", f"WITH {S}, E AS (SELECT min(value) AS a, max(value) AS b FROM S), X AS (SELECT CASE WHEN a > 0 AND b / a > 100 THEN ln(value / a) / ln(b / a) ELSE (value - a) / (b - a) END AS p FROM S, E) SELECT CAST(greatest(1, least(96, ceil(p * 96 - 1e-9))) AS INTEGER) AS bin, count(*) AS count FROM X GROUP BY ALL")(
    lambda s, d: _numbered(distributions.sample_bins(src.samples(s, d), "value"))
)


def _numbered(rows: DataFrame) -> DataFrame:
    """The bins by number: their edges are equally far apart on the scale that was chosen."""
    ends = rows.agg(F.min("bucket_lo").alias("a"), F.max("bucket_hi").alias("b")).first()
    logs = ends["a"] > 0 and ends["b"] / ends["a"] > 100
    x = F.log(F.col("bucket_hi") / ends["a"]) / F.log(F.lit(ends["b"] / ends["a"])) if logs else (F.col("bucket_hi") - ends["a"]) / (ends["b"] - ends["a"])
    return rows.select(F.round(x * 96).cast("int").alias("bin"), "count")


_LABELS = "('+Inf'), ('0.5'), ('1e3'), ('x'), (' Inf'), ('-inf')"
register("le_parse", f"SELECT le, {special('CASE le WHEN ' + repr('+Inf') + ' THEN CAST(' + repr('Infinity') + ' AS DOUBLE) WHEN ' + repr(' Inf') + ' THEN CAST(' + repr('Infinity') + ' AS DOUBLE) WHEN ' + repr('-inf') + ' THEN CAST(' + repr('-Infinity') + ' AS DOUBLE) WHEN ' + repr('0.5') + ' THEN 0.5::DOUBLE WHEN ' + repr('1e3') + ' THEN 1000::DOUBLE END')} AS edge FROM (VALUES {_LABELS}) v(le)")(
    lambda s, d: values(s, _LABELS, "le").withColumn("e", distributions.edge_of(F.col("le"))).selectExpr("le", f"{special('e')} AS edge")
)
_OUTCOMES = "('200'), ('302'), ('404'), ('503'), ('OK'), ('Timeout'), ('maybe'), ('0')"
register("outcome", f"SELECT v, CASE WHEN v IN ('200', '302', 'OK', '0') THEN 'success' WHEN v IN ('503', 'Timeout') THEN 'failure' END AS outcome FROM (VALUES {_OUTCOMES}) x(v)")(lambda s, d: values(s, _OUTCOMES, "v").withColumn("outcome", distributions.outcome("code", F.col("v"))))

# --- edge rules on rows that hold them ---
_HQ = "('a', 1.0, 2.0), ('a', 2.0, 6.0), ('b', 1.0, 2.0), ('b', CAST('Infinity' AS DOUBLE), 4.0), ('c', 1.0, 0.0), ('c', CAST('Infinity' AS DOUBLE), 0.0), ('d', -1.0, 3.0), ('d', 1.0, 4.0), ('d', CAST('Infinity' AS DOUBLE), 4.0), ('e', CAST('Infinity' AS DOUBLE), 4.0), ('f', 1.0, 5.0), ('f', 2.0, 3.0), ('f', 4.0, 9.0), ('f', CAST('Infinity' AS DOUBLE), 10.0)"
for _name, _q, _want in (("histogram_quantile_edges", 0.6, "('a', 'NaN'), ('b', '1.0'), ('c', 'NaN'), ('d', '-1.0'), ('e', 'NaN'), ('f', '2.5')"), ("histogram_quantile_above_one", 1.5, "('a', '+Inf'), ('b', '+Inf'), ('c', '+Inf'), ('d', '+Inf'), ('e', '+Inf'), ('f', '+Inf')")):
    register(_name, f"SELECT * FROM (VALUES {_want}) v(k, value)")(lambda s, d, q=_q: vectors.histogram_quantile(values(s, _HQ, "k, le, value").select("k", F.col("le").cast("double"), F.col("value").cast("double")), ["k"], q).selectExpr("k", f"{special('value')} AS value"))
_DIV = "(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (1.0, -0.0), (-1.0, -0.0)"
register("division_edges", "SELECT * FROM (VALUES ('1.0', '0.0', '+Inf'), ('-1.0', '0.0', '-Inf'), ('0.0', '0.0', 'NaN'), ('6.0', '3.0', '2.0'), ('1.0', '-0.0', '-Inf'), ('-1.0', '-0.0', '+Inf')) v(a, b, q)")(
    lambda s, d: s.sql("SELECT * FROM VALUES (1.0D, 0.0D), (-1.0D, 0.0D), (0.0D, 0.0D), (6.0D, 3.0D), (1.0D, -0.0D), (-1.0D, -0.0D) AS v(a, b)").withColumn("q", ieee.div(F.col("a"), F.col("b"))).selectExpr("CAST(a AS STRING) AS a", "CAST(b AS STRING) AS b", f"{special('q')} AS q")
)
_RB = "(1, 'known', 10.0, 8.0, 12.0, 5), (2, 'known', 40.0, 1.0, 41.0, 15), (1, 'unknown', 10.0, 8.0, 12.0, 5), (2, 'unknown', 40.0, 1.0, 41.0, NULL), (1, 'nan', CAST('NaN' AS DOUBLE), CAST('NaN' AS DOUBLE), CAST('NaN' AS DOUBLE), 7), (1, 'torn', 3.0, NULL, 4.0, 1), (2, 'torn', 5.0, 2.0, 7.0, 1)"
register("rebucket_edges", "SELECT k, 8 AS ts_ms, avg, min, max, count FROM (VALUES ('known', '32.5', '1.0', '41.0', '20'), ('unknown', '25.0', '1.0', '41.0', 'unknown'), ('nan', 'NaN', 'NaN', 'NaN', '7'), ('torn', '4.0', NULL, '7.0', '2')) v(k, avg, min, max, count)")(
    lambda s, d: buckets.rebucket(values(s, _RB, "ts_ms, k, avg, min, max, count").select("k", "ts_ms", *[F.col(c).cast("double").alias(c) for c in ("avg", "min", "max")], "count"), ["k"], 8, "sample_mean").selectExpr("k", "ts_ms", *[f"{special(c)} AS {c}" for c in ("avg", "min", "max")], "coalesce(CAST(count AS STRING), 'unknown') AS count")
)
_LS = f"{S}, W AS (SELECT event_type, ts_ms, 1e9 + 10 * sin(ts_ms * 2 * pi() / {DAY}) AS value FROM S)"
register("lomb_scargle_high_level", f"WITH {_LS} SELECT event_type, CAST({DAY} AS BIGINT) AS period_ms, 1.0::DOUBLE AS power FROM W GROUP BY event_type")(
    lambda s, d: rounded(series.lomb_scargle(src.samples(s, d).withColumn("value", 1e9 + 10 * F.sin(F.col("ts_ms") * (2 * 3.141592653589793 / DAY))), KEY, [DAY]), "power", digits=4)
)
register("lomb_scargle_constant", f"WITH {S} SELECT event_type, CAST({DAY} AS BIGINT) AS period_ms, 0.0::DOUBLE AS power FROM S GROUP BY event_type")(lambda s, d: series.lomb_scargle(src.samples(s, d).withColumn("value", F.lit(7.0)), KEY, [DAY]))

# --- bucket states over the whole table: the grid ends at the bucket of the last event ---
_W0, _W1 = (f"(SELECT {end(HOUR, f)} {o} FROM S)" for f, o in (("min(ts_ms)", f"- {HOUR}"), ("max(ts_ms)", "")))
_WHOLE = f"""{S}, N AS (SELECT event_type, {end(HOUR)} AS ts_ms, CAST(count(*) AS DOUBLE) AS observed FROM S GROUP BY ALL),
U AS (SELECT event_type, min(ts_ms) AS first, quantile_cont(observed, 0.5) AS usual FROM N GROUP BY ALL),
GR AS (SELECT event_type, first, usual, unnest(generate_series({_W0} + {HOUR}, {_W1}, {HOUR})) AS ts_ms FROM U),
Y AS (SELECT event_type, ts_ms, coalesce(observed, 0)::DOUBLE AS observed, CASE WHEN ts_ms < first THEN 0 ELSE usual END::DOUBLE AS expected, CASE WHEN ts_ms < first THEN 3 WHEN coalesce(observed, 0) = 0 THEN 2 WHEN observed < usual - (greatest(1, usual * 0.1) + 0.1) THEN 1 ELSE 0 END AS state FROM GR LEFT JOIN N USING (event_type, ts_ms)),
WS AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY event_type ORDER BY ts_ms) IN (2, 4) AND state IN (0, 1) THEN 16 ELSE 0 END AS flags FROM Y)"""


def whole_states(s: SparkSession, d: str) -> DataFrame:
    rows = src.samples(s, d)
    ends = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    first, last = (-(-x // HOUR) * HOUR for x in ends)
    return state.presence(rows, KEY, HOUR, first - HOUR, last)


register("bucket_state_whole_table", f"WITH {_WHOLE} SELECT event_type, ts_ms, observed, expected, state, flags FROM WS")(whole_states)
register("state_coarsen_whole_table", f"WITH {_WHOLE} SELECT event_type, {end(SIX)} AS ts_ms, coalesce(sum(observed) FILTER (state <> 3), 0)::DOUBLE AS observed, coalesce(sum(expected) FILTER (state <> 3), 0)::DOUBLE AS expected, bit_or(flags) AS flags FROM WS GROUP BY ALL")(
    lambda s, d: state.coarsen(whole_states(s, d), KEY, SIX).drop("state")
)
register("state_group_merge_whole_table", f"WITH {_WHOLE} SELECT ts_ms, count(*) FILTER (state <> 3) AS alive, count(*) FILTER (state IN (0, 1)) AS reporting, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (state = 2), '') AS silent FROM WS GROUP BY ts_ms")(
    lambda s, d: state.merge_group(whole_states(s, d), "event_type").select("ts_ms", "alive", "reporting", "silent")
)
register("coverage_verdict", f"WITH {_WHOLE} SELECT event_type, sum(observed) AS observed, sum(expected) AS expected, count(*) FILTER (state = 4) AS unknown, count(*) AS buckets, round(sum(observed) / sum(expected), 7) AS share, CASE WHEN sum(observed) = 0 THEN 'none' WHEN sum(observed) / sum(expected) >= 0.9 THEN 'enough' ELSE 'thin' END AS verdict FROM WS GROUP BY ALL")(
    lambda s, d: rounded(summaries.coverage_verdict(whole_states(s, d), KEY), "share")
)
register("state_spans", f"WITH {_WHOLE}, I AS (SELECT event_type, state, ts_ms, ts_ms - row_number() OVER (PARTITION BY event_type, state ORDER BY ts_ms) * {HOUR} AS i FROM WS WHERE state <> 0) SELECT event_type, state, min(ts_ms) AS start, max(ts_ms) AS \"end\", count(*) AS n FROM I GROUP BY event_type, state, i")(
    lambda s, d: sequences.runs(whole_states(s, d).filter("state <> 0"), ["event_type", "state"], HOUR)
)
