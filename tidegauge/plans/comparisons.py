"""Roles and Little's law, operating profiles, and earlier cycles, over events; with SQL that ranks, enumerates or joins
where the plans use sums and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import bucket_end_left_closed
from tidegauge.kernels.tails import t_isf
from tidegauge.operators import cycles, documents, profile, roles
from tidegauge.plans.catalogue import B, DAY, DD, HOUR, KEY, SIX, S, dist, left_end, rounded
from tidegauge.registry import register
from tidegauge.sources import events as src

_BOTH = ["event_type", "instance"]
_WIDTH, _BLOCK = 24, 6

# --- roles: what arrives, how long it takes, what is inside; some instances lack one of them ---
_P = "P AS (SELECT event_type, instance, ts_ms AS a, ts_ms + 60000 + CAST(floor(value) AS BIGINT) * 20000 AS b FROM S)"


def system(s: SparkSession, d: str) -> dict[str, DataFrame]:
    spans = src.samples(s, d).select(*_BOTH, F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 60_000 + F.floor("value") * 20_000).alias("end_ms"))
    began = spans.groupBy(*_BOTH, bucket_end_left_closed(F.col("start_ms"), HOUR).alias("ts_ms")).agg((F.count("*") / 3600).alias("value"))
    ended = spans.groupBy(*_BOTH, bucket_end_left_closed(F.col("end_ms"), HOUR).alias("ts_ms"))
    spent = ended.agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000).alias("value"))
    inside = documents.in_flight(spans, _BOTH, HOUR).select(*_BOTH, "ts_ms", F.col("avg").alias("value"))
    return {roles.ARRIVALS: began, roles.SPENT: spent.filter("instance <> 1"), roles.DONE: ended.agg(F.count("*").cast("double").alias("value")).filter("instance <> 1"), roles.INSIDE: inside.filter("instance < 8")}


def aligned(s: SparkSession, d: str) -> DataFrame:
    return roles.align(system(s, d), _BOTH)


def by_type(s: SparkSession, d: str) -> DataFrame:
    """Roles by event type, from the groups that have all, on each hour between the first and the last: nothing inside is 0."""
    whole = roles.matched(aligned(s, d), _BOTH, list(roles.ROLES)).groupBy("event_type", "ts_ms").agg(*[F.sum(r).alias(r) for r in roles.ROLES])
    edge = whole.groupBy("event_type").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    grid = edge.select("event_type", F.explode(F.sequence("a", "b", F.lit(HOUR).cast("long"))).alias("ts_ms"))
    return grid.join(whole, ["event_type", "ts_ms"], "left").withColumn(roles.INSIDE, F.coalesce(roles.INSIDE, F.lit(0.0)))


def _start(s: SparkSession, d: str) -> int:
    return (src.samples(s, d).agg(F.min("ts_ms")).first()[0] or 0) // DAY * DAY


_AL = f"""{S}, {_P},
ARR AS (SELECT event_type, instance, CAST((a // {HOUR}) * {HOUR} + {HOUR} AS BIGINT) AS ts_ms, count(*) / 3600.0 AS v FROM P GROUP BY ALL),
FIN AS (SELECT event_type, instance, CAST((b // {HOUR}) * {HOUR} + {HOUR} AS BIGINT) AS ts_ms, sum(b - a) / 1000.0 AS s, CAST(count(*) AS DOUBLE) AS n FROM P WHERE instance <> 1 GROUP BY ALL),
INS AS (SELECT event_type, instance, ts_ms, sum(least(b, ts_ms) - greatest(a, ts_ms - {HOUR})) / {HOUR} AS v FROM (SELECT event_type, instance, a, b, unnest(generate_series((a // {HOUR}) * {HOUR} + {HOUR}, (b // {HOUR}) * {HOUR} + {HOUR}, {HOUR})) AS ts_ms FROM P WHERE instance < 8) GROUP BY ALL),
AL AS (SELECT event_type, instance, ts_ms, ARR.v AS arrivals, FIN.s AS spent, FIN.n AS done, INS.v AS inside FROM ARR FULL JOIN FIN USING (event_type, instance, ts_ms) FULL JOIN INS USING (event_type, instance, ts_ms))"""
register("roles_aligned", f"WITH {_AL} SELECT event_type, instance, ts_ms, round(arrivals, 9) AS arrivals, round(spent, 6) AS spent, done, round(inside, 7) AS inside FROM AL")(lambda s, d: rounded(rounded(rounded(aligned(s, d), "arrivals", digits=9), "spent", digits=6), "inside"))
_HAS = "HAS AS (SELECT event_type, instance, count(arrivals) > 0 AS a, count(spent) > 0 AS b, count(done) > 0 AS c, count(inside) > 0 AS d FROM AL GROUP BY ALL)"
_LIST = ", ".join(f"CASE WHEN {{n}} {c} THEN '{r}' END" for c, r in zip("abcd", roles.ROLES, strict=True))
register("roles_unmatched", f"WITH {_AL}, {_HAS} SELECT event_type, instance, concat_ws(',', {_LIST.format(n='')}) AS present, concat_ws(',', {_LIST.format(n='NOT')}) AS missing FROM HAS WHERE NOT (a AND b AND c AND d)")(lambda s, d: roles.unmatched(aligned(s, d), _BOTH, list(roles.ROLES)))
register("roles_combined", f"WITH {_AL} SELECT ts_ms, round(sum(arrivals), 9) AS arrivals, round(sum(spent), 6) AS spent, sum(done) AS done, round(sum(inside), 7) AS inside FROM AL GROUP BY ts_ms")(lambda s, d: rounded(rounded(rounded(roles.combine(aligned(s, d), list(roles.ROLES)), "arrivals", digits=9), "spent", digits=6), "inside"))

_T = ", ".join(f"({n}, {t_isf(roles.ALPHA / 2, n - 1)!r}::DOUBLE)" for n in range(2, _WIDTH // _BLOCK + 1))
_LAW = "sum(inside) * sum(done) / nullif(sum(arrivals) * sum(spent), 0)"
_LW = f"""{_AL}, {_HAS},
TY AS (SELECT event_type, ts_ms, sum(arrivals) AS arrivals, sum(spent) AS spent, sum(done) AS done, sum(inside) AS inside FROM AL JOIN HAS USING (event_type, instance) WHERE a AND b AND c AND d GROUP BY ALL),
GR AS (SELECT event_type, unnest(generate_series(min(ts_ms), max(ts_ms), {HOUR})) AS ts_ms FROM TY GROUP BY event_type),
RW AS (SELECT event_type, g.ts_ms, coalesce(arrivals, 0) AS arrivals, coalesce(spent, 0) AS spent, coalesce(done, 0) AS done, coalesce(inside, 0) AS inside FROM GR g LEFT JOIN TY USING (event_type, ts_ms)),
T0 AS (SELECT min(ts_ms) // {DAY} * {DAY} AS t0 FROM S),
TA AS (SELECT *, (ts_ms - t0) // {HOUR} - 1 - grid * {_WIDTH // 2} AS pos FROM RW, T0, (VALUES (0), (1)) g(grid)),
BL AS (SELECT event_type, grid, pos // {_WIDTH} AS "window", pos % {_WIDTH} // {_BLOCK} AS b, count(*) AS n, {_LAW} AS law, sum(arrivals) AS arrivals, sum(spent) AS spent, sum(done) AS done, sum(inside) AS inside FROM TA WHERE pos >= 0 GROUP BY ALL),
WI AS (SELECT event_type, grid, "window", sum(n) AS n, {_LAW} AS ratio, sum(arrivals) AS arrivals, sum(spent) AS spent, sum(done) AS done, sum(inside) AS inside, count(CASE WHEN n = {_BLOCK} AND law > 0 THEN 1 END) AS blocks, stddev_samp(CASE WHEN n = {_BLOCK} AND law > 0 THEN ln(law) END) AS scatter FROM BL GROUP BY ALL),
WH AS (SELECT *, CASE WHEN blocks >= 3 THEN scatter / sqrt(blocks) * t END AS half FROM WI LEFT JOIN (VALUES {_T}) tt(k, t) ON k = blocks),
WV AS (SELECT *, CASE WHEN n < {_WIDTH} THEN 'insufficient' WHEN arrivals = 0 THEN 'no_traffic' WHEN half IS NULL OR ratio IS NULL THEN 'insufficient' WHEN ln(ratio) > half + 1e-9 THEN 'L_high' WHEN ln(ratio) < -half - 1e-9 THEN 'L_low' ELSE 'consistent' END AS verdict FROM WH)"""


def law_windows(s: SparkSession, d: str) -> DataFrame:
    return roles.windows(by_type(s, d), KEY, HOUR, _WIDTH, _BLOCK, _start(s, d))


register(
    "littles_windows",
    f"""WITH {_LW} SELECT event_type, CAST(grid AS INTEGER) AS grid, CAST("window" AS BIGINT) AS "window", CAST(t0 + (grid * {_WIDTH // 2} + ("window" + 1) * {_WIDTH}) * {HOUR} AS BIGINT) AS end_ms, CAST(n AS BIGINT) AS n, round(inside / n, 6) AS l, round(arrivals / {_WIDTH}, 9) AS arrival_rate, round(spent / nullif(done, 0), 6) AS w, round(ratio, 6) AS ratio, blocks, round(scatter, 6) AS scatter, round(ratio * exp(-half), 6) AS low, round(ratio * exp(half), 6) AS high, verdict FROM WV, T0""",
)(lambda s, d: rounded(rounded(law_windows(s, d), "arrival_rate", digits=9), "l", "w", "ratio", "scatter", "low", "high", digits=6))
register(
    "littles_verdict",
    f"""WITH {_LW}, OFF AS (SELECT * FROM WV WHERE verdict IN ('L_high', 'L_low')), X AS (SELECT o.event_type, count(*) AS extra FROM OFF o WHERE grid = 1 AND NOT EXISTS (SELECT 1 FROM OFF m WHERE m.event_type = o.event_type AND m.grid = 0 AND m."window" BETWEEN o."window" AND o."window" + 1) GROUP BY ALL),
M AS (SELECT event_type, count(*) AS windows, count(*) FILTER (verdict IN ('L_high', 'L_low')) AS off, count(*) FILTER (verdict = 'consistent') AS fine FROM WV WHERE grid = 0 GROUP BY ALL)
SELECT event_type, CASE WHEN off + coalesce(extra, 0) > 0 THEN 'inconsistent_in_windows' WHEN fine > 0 THEN 'consistent' ELSE 'insufficient' END AS verdict, windows, off, coalesce(extra, 0) AS shifted_only FROM M LEFT JOIN X USING (event_type)""",
)(lambda s, d: roles.judged(law_windows(s, d), KEY))

# --- profiles by the local clock ---
_ZONE = "Asia/Kolkata"
_SHIFT = 19_800_000  # that zone has no summer time
_HM = f"{B}, HM AS (SELECT event_type, ts_ms, avg AS x, CAST(((ts_ms - {HOUR} + {_SHIFT}) // {HOUR} + 72) % 168 AS INTEGER) AS how FROM B)"
_RS = f"""{_HM}, PL AS (SELECT *, CASE period WHEN 'none' THEN 0 WHEN 'hour_of_day' THEN how % 24 ELSE how END AS place FROM HM, (VALUES ('none', 1), ('hour_of_day', 24), ('hour_of_week', 168)) p(period, size)),
NN AS (SELECT event_type, period, size, place, count(*) AS n, quantile_cont(x, 0.5) AS level, list(x ORDER BY x) AS xs FROM PL GROUP BY ALL),
RK AS (SELECT *, row_number() OVER (PARTITION BY event_type, period, place ORDER BY x, ts_ms) AS r FROM PL),
RE AS (SELECT RK.*, n, CASE WHEN n >= 3 THEN x - (xs[(n - 1 + 1) // 2 + CASE WHEN (n - 1 + 1) // 2 >= r THEN 1 ELSE 0 END] + xs[(n - 1 + 2) // 2 + CASE WHEN (n - 1 + 2) // 2 >= r THEN 1 ELSE 0 END]) / 2 END AS resid FROM RK JOIN NN USING (event_type, period, size, place)),
ABLE AS (SELECT event_type, period FROM NN GROUP BY event_type, period, size HAVING count(*) FILTER (n >= 3) >= 0.9 * size),
MET AS (SELECT RE.* FROM RE JOIN ABLE USING (event_type, period) WHERE resid IS NOT NULL),
ALLM AS (SELECT event_type, count(*) AS m FROM ABLE GROUP BY event_type),
WHOLE AS (SELECT event_type, ts_ms FROM MET JOIN ALLM USING (event_type) GROUP BY event_type, ts_ms, m HAVING count(*) = m),
SC AS (SELECT event_type, avg(abs(resid)) FILTER (period = 'none') AS s0, avg(abs(resid)) FILTER (period = 'hour_of_day') AS s1, avg(abs(resid)) FILTER (period = 'hour_of_week') AS s2 FROM MET JOIN WHOLE USING (event_type, ts_ms) GROUP BY event_type),
C1 AS (SELECT *, CASE WHEN s1 < 0.98 * s0 THEN 'hour_of_day' ELSE 'none' END AS p1 FROM SC),
CH AS (SELECT *, CASE WHEN s2 < 0.98 * CASE p1 WHEN 'none' THEN s0 ELSE s1 END THEN 'hour_of_week' ELSE p1 END AS period FROM C1)"""
#: A daily course, so that a richer model is chosen for some types: a swing by the local hour added to every hour's mean.
_SWING = {"click": 40.0, "view": 5.0}


def hours(s: SparkSession, d: str) -> DataFrame:
    how = profile.local_hour(F.col("ts_ms") - HOUR, _ZONE)
    swing = F.when(F.col("event_type") == "click", 40.0).when(F.col("event_type") == "view", 5.0).otherwise(0.0) * (how % 24) / 23
    return src.buckets(s, d, HOUR).select("event_type", "ts_ms", (F.col("avg") + swing).alias("x"))


_SWUNG = _RS.replace("avg AS x, CAST(", "avg + CASE event_type WHEN 'click' THEN 40.0 WHEN 'view' THEN 5.0 ELSE 0.0 END * (((ts_ms - %d + %d) // %d + 72) %% 168 %% 24) / 23 AS x, CAST(" % (HOUR, _SHIFT, HOUR), 1)
register("profile_choice", f"WITH {_SWUNG} SELECT event_type, period, round(s0, 6) AS none, round(s1, 6) AS hour_of_day, round(s2, 6) AS hour_of_week FROM CH")(
    lambda s, d: rounded(profile.choice(profile.residuals(hours(s, d), KEY, _ZONE), KEY).select("event_type", "period", *[F.try_element_at("scores", F.lit(p)).alias(p) for p in profile.PERIODS]), *profile.PERIODS, digits=6)
)
_at = lambda q: f"(CASE WHEN len(rs) = 0 THEN NULL ELSE rs[CAST(floor(h{q}) AS BIGINT) + 1] + (rs[CAST(ceil(h{q}) AS BIGINT) + 1] - rs[CAST(floor(h{q}) AS BIGINT) + 1]) * (h{q} - floor(h{q})) END)"
_QS = {"lo": 0.05, "q25": 0.25, "q75": 0.75, "hi": 0.95}
_SE = f"""{_SWUNG}, MI AS (SELECT RE.*, how % 24 AS hod FROM RE JOIN CH USING (event_type, period)),
RI AS (SELECT event_type, period, count(*) FILTER (c >= 20) = 24 AND period <> 'none' AS by_hour FROM (SELECT event_type, period, hod, count(resid) AS c FROM MI GROUP BY ALL) GROUP BY event_type, period),
PO AS (SELECT event_type, CASE WHEN by_hour THEN hod ELSE -1 END AS pool, list(resid ORDER BY resid) FILTER (resid IS NOT NULL) AS rs FROM MI JOIN RI USING (event_type, period) GROUP BY ALL),
PH AS (SELECT *, {', '.join(f"greatest(0, least(len(rs) - 1, (len(rs) + 1) * {q} - 1)) AS h{n}" for n, q in _QS.items())} FROM PO),
PQ AS (SELECT event_type, pool, {', '.join(f"{_at(n)} AS {n}" for n in _QS)} FROM PH),
SE AS (SELECT event_type, NN.period, place, NN.n, CASE WHEN NN.n >= 3 THEN level END AS level, CASE WHEN by_hour THEN place % 24 ELSE -1 END AS pool FROM NN JOIN CH USING (event_type, period) JOIN RI USING (event_type, period)),
SB AS (SELECT event_type, period, place, n, level, {', '.join(f"level + {q} AS {q}" for q in _QS)}, pool FROM SE LEFT JOIN PQ USING (event_type, pool))"""
register("profile_band", f"WITH {_SE} SELECT event_type, period, CAST(place AS INTEGER) AS place, n, round(level, 6) AS level, {', '.join(f'round({q}, 6) AS {q}' for q in _QS)}, CASE WHEN pool < 0 THEN 'all' ELSE 'hour_of_day' END AS pool FROM SB")(
    lambda s, d: rounded(profile.seasonal(hours(s, d), KEY, _ZONE), "level", *_QS, digits=6)
)
register("profile_band_at", f"""WITH {_SE} SELECT HM.event_type, HM.ts_ms, round(level, 6) AS level, CASE WHEN x < lo THEN 'below' WHEN x > hi THEN 'above' WHEN level IS NOT NULL THEN 'inside' END AS "where" FROM HM JOIN CH USING (event_type) LEFT JOIN SB ON SB.event_type = HM.event_type AND SB.place = CASE CH.period WHEN 'none' THEN 0 WHEN 'hour_of_day' THEN how % 24 ELSE how END""")(
    lambda s, d: rounded(profile.band_at(hours(s, d), profile.seasonal(hours(s, d), KEY, _ZONE), KEY, _ZONE).select("event_type", "ts_ms", "level", "where"), "level", digits=6)
)

# --- earlier cycles: the last whole day against the days and weeks before ---
_CY = f"""{DD}, ND AS (SELECT max(ts_ms) // {DAY} * {DAY} AS b FROM DD),
OF AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {j}, {j * days}::BIGINT)" for n, (days, k) in cycles.SCHEMES.items() for j in range(k + 1))}) o(scheme, j, days)),
DL AS (SELECT event_type, scheme, j, ts_ms, bucket_lo, bucket_hi, count FROM DD, ND, OF WHERE ts_ms + days * {DAY} > b - {DAY} AND ts_ms + days * {DAY} <= b),
CV AS (SELECT event_type, scheme, j, count(DISTINCT ts_ms) / {DAY / SIX} AS coverage FROM DL GROUP BY ALL),
CH AS (SELECT event_type, scheme, j, bucket_lo, bucket_hi, sum(count) AS count, coverage FROM DL JOIN CV USING (event_type, scheme, j) GROUP BY ALL)"""


def earlier(s: SparkSession, d: str) -> DataFrame:
    """Berlin's clocks do not change within the table."""
    rows = dist(s, d)
    end = (rows.agg(F.max("ts_ms")).first()[0] or 0) // DAY * DAY
    return cycles.cycle_hists(rows, KEY, end - DAY, end, SIX, "Europe/Berlin")


register("cycle_hists", f"WITH {_CY} SELECT event_type, scheme, j, bucket_lo, bucket_hi, count, coverage FROM CH")(earlier)
_CE = f"""{_CY}, ED AS (SELECT DISTINCT event_type, scheme, unnest([bucket_lo, bucket_hi]) AS edge FROM CH),
CE AS (SELECT * FROM ED WHERE NOT EXISTS (SELECT 1 FROM CH WHERE CH.event_type = ED.event_type AND CH.scheme = ED.scheme AND bucket_lo < edge AND edge < bucket_hi))"""
register("cycle_common_edges", f"WITH {_CE} SELECT event_type, scheme, edge FROM CE")(lambda s, d: cycles.common_edges(earlier(s, d), [*KEY, "scheme"]))
_FT = ", ".join(f"({k}, {m}, {t_isf(p / 2, m - 1)!r}::DOUBLE)" for k, p in cycles.FORWARD.items() for m in range(2, k))
_KT = ", ".join(f"({k}, {t_isf(cycles.ALPHA / 2, k - 1)!r}::DOUBLE)" for k in range(2, 9))


def _grown(before: str, after: str) -> str:
    """One step of the forward search over ranks a to b."""
    return f"""{after}_0 AS (SELECT g.*, (SELECT avg(l) FROM LV x WHERE x.event_type = g.event_type AND x.scheme = g.scheme AND r BETWEEN a AND b) AS mu, greatest((SELECT stddev_samp(l) FROM LV x WHERE x.event_type = g.event_type AND x.scheme = g.scheme AND r BETWEEN a AND b), floor) * sqrt(1 + 1.0 / (b - a + 1)) AS dev FROM {before} g),
{after}_1 AS (SELECT g.*, coalesce(abs(p.l - mu) / nullif(dev, 0), CASE WHEN p.l IS NULL THEN 1e300 ELSE 0 END) AS u, coalesce(abs(q.l - mu) / nullif(dev, 0), CASE WHEN q.l IS NULL THEN 1e300 ELSE 0 END) AS w, coalesce(t, 1e300) AS t FROM {after}_0 g LEFT JOIN LV p ON p.event_type = g.event_type AND p.scheme = g.scheme AND p.r = a - 1 LEFT JOIN LV q ON q.event_type = g.event_type AND q.scheme = g.scheme AND q.r = b + 1 LEFT JOIN (VALUES {_FT}) f(k0, m0, t) ON k0 = g.k AND m0 = b - a + 1),
{after} AS (SELECT event_type, scheme, k, floor, open AND b - a + 1 < k AND least(u, w) <= t AS open, CASE WHEN open AND b - a + 1 < k AND least(u, w) <= t AND u <= w THEN a - 1 ELSE a END AS a, CASE WHEN open AND b - a + 1 < k AND least(u, w) <= t AND u > w THEN b + 1 ELSE b END AS b FROM {after}_1)"""


_CP = f"""{_CE}, AB AS (SELECT CE.event_type, CE.scheme, edge, sum(count) FILTER (bucket_lo >= edge) / sum(count) AS above FROM CE JOIN CH ON CH.event_type = CE.event_type AND CH.scheme = CE.scheme AND j = 0 GROUP BY ALL),
TH AS (SELECT event_type, scheme, arg_min(edge, round(abs(coalesce(above, 0) - 0.1), 9) + edge * 1e-13) AS x FROM AB GROUP BY ALL),
SH AS (SELECT event_type, scheme, j, x, sum(count) AS n, coalesce(sum(count) FILTER (bucket_lo >= x), 0) AS o, max(coverage) AS coverage FROM CH JOIN TH USING (event_type, scheme) GROUP BY ALL),
LG AS (SELECT *, ln((o + 0.5) / (n + 1) / (1 - (o + 0.5) / (n + 1))) AS l, 1 / ((n + 1) * ((o + 0.5) / (n + 1)) * (1 - (o + 0.5) / (n + 1))) AS v FROM SH),
US AS (SELECT * FROM LG WHERE j > 0 AND n > 0 AND coverage >= 0.5),
LV AS (SELECT *, row_number() OVER (PARTITION BY event_type, scheme ORDER BY l, j) - 1 AS r FROM US),
ER AS (SELECT a.event_type, a.scheme, a.j, abs(a.l - avg(b.l)) AS e FROM US a JOIN US b ON a.event_type = b.event_type AND a.scheme = b.scheme AND a.j <> b.j GROUP BY a.event_type, a.scheme, a.j, a.l),
SO AS (SELECT event_type, scheme, avg(e) AS score FROM ER GROUP BY ALL),
KK AS (SELECT event_type, scheme, count(*) AS k, sqrt(avg(v)) AS floor FROM US GROUP BY ALL),
MA AS (SELECT KK.*, unnest(range(1, 256)) AS mask FROM KK WHERE k > 3),
MV AS (SELECT MA.event_type, MA.scheme, MA.k, floor, mask, var_samp(l) AS var, min(r) AS a, max(r) AS b FROM MA JOIN LV ON LV.event_type = MA.event_type AND LV.scheme = MA.scheme AND (mask >> r) & 1 = 1 WHERE mask < (1 << k) AND bit_count(mask) = k - CASE WHEN k <= 5 THEN 1 ELSE 2 END GROUP BY ALL),
G0 AS (SELECT event_type, scheme, k, floor, true AS open, a, b FROM MV QUALIFY row_number() OVER (PARTITION BY event_type, scheme ORDER BY var, a) = 1 UNION ALL SELECT event_type, scheme, k, floor, false, 0, k - 1 FROM KK WHERE k <= 3),
{_grown('G0', 'G1')}, {_grown('G1', 'G2')},
NO AS (SELECT G2.event_type, G2.scheme, count(*) AS kept, avg(l) AS m, greatest(var_samp(l), avg(v)) AS s2, avg(v) AS mv FROM G2 JOIN LV ON LV.event_type = G2.event_type AND LV.scheme = G2.scheme AND r BETWEEN a AND b GROUP BY ALL),
CM AS (SELECT g.event_type, g.scheme, g.x, coalesce(k, 0) AS cycles, kept, score, g.o / g.n AS share, g.l AS l0, m, t * sqrt(s2 * (1 + 1.0 / kept) + greatest(0, g.v - mv)) AS wide, coalesce(k, 0) >= 3 AND g.n > 0 AS enough
  FROM LG g LEFT JOIN KK ON KK.event_type = g.event_type AND KK.scheme = g.scheme LEFT JOIN SO ON SO.event_type = g.event_type AND SO.scheme = g.scheme LEFT JOIN NO ON NO.event_type = g.event_type AND NO.scheme = g.scheme LEFT JOIN (VALUES {_KT}) tt(tk, t) ON tk = kept WHERE g.j = 0),
CO AS (SELECT event_type, scheme, x, cycles, CASE WHEN enough THEN kept END AS kept, CASE WHEN enough THEN score END AS score, share, CASE WHEN enough THEN 1 / (1 + exp(wide - m)) END AS normal_lo, CASE WHEN enough THEN 1 / (1 + exp(-m - wide)) END AS normal_hi,
  CASE WHEN NOT enough THEN 'insufficient_history' WHEN l0 > m + wide THEN 'unusual_high' WHEN l0 < m - wide THEN 'unusual_low' ELSE 'usual' END AS verdict FROM CM)"""
register("seasonal_tail", f"WITH {_CP} SELECT event_type, scheme, x, cycles, kept, round(score, 6) AS score, round(share, 6) AS share, round(normal_lo, 6) AS normal_lo, round(normal_hi, 6) AS normal_hi, verdict FROM CO")(
    lambda s, d: rounded(cycles.compare(earlier(s, d), KEY), "score", "share", "normal_lo", "normal_hi", digits=6)
)
register("seasonal_choice", f"WITH {_CP}, W AS (SELECT event_type, max(score) FILTER (scheme = '1d') AS a, max(score) FILTER (scheme = '1w') AS b FROM CO WHERE score IS NOT NULL GROUP BY ALL) SELECT event_type, CASE WHEN a IS NULL THEN '1w' WHEN b < 0.95 * a THEN '1w' ELSE '1d' END AS scheme FROM W")(
    lambda s, d: cycles.choose(cycles.compare(earlier(s, d), KEY), KEY)
)
