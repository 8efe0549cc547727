"""Bucket states by cadence over whole tables, each with the same rules in SQL: raw series at several rates, a cadence a
little slower than the step, and scrapes that fall to either side of a bucket's border."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import bucket_end
from tidegauge.operators import cadence, discovery, spans
from tidegauge.plans.catalogue import HOUR, KEY, SIX, C, G, S, end, rounded
from tidegauge.registry import register
from tidegauge.sources import events as src

_BOTH = ["event_type", "instance"]
#: Interval of a cadence that skips every eleventh bucket.
SIXTY_SIX = 66 * 60_000
_ZERO = 1704067200000


def counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys, bucket_end(F.col("ts_ms"), HOUR).alias("ts_ms")).agg(F.count("*").cast("double").alias("observed"))


def outages(s: SparkSession, d: str) -> DataFrame:
    """Three hours from each two-thousandth event on."""
    return src.samples(s, d).filter(F.col("event_id") % 2000 == 0).select(F.col("ts_ms").alias("a"), (F.col("ts_ms") + 3 * HOUR).alias("b"))


def scraped(s: SparkSession, d: str, every: int, jitter: bool) -> DataFrame:
    """A scrape every so often in each series, the small values of it lost; with jitter, a millisecond to either side."""
    rows = src.gauge(s, d).withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("ts_ms")))
    at = F.lit(_ZERO) + F.col("n").cast("long") * every + (F.floor("value") % 3 - 1 if jitter else F.lit(0))
    return rows.filter("value >= 2").select("event_type", at.alias("ts_ms"), "value")


def states(n: DataFrame, keys: list[str], **more: object) -> DataFrame:
    edge = n.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    found = cadence.by_cadence(n, keys, HOUR, (edge[0] or HOUR) - HOUR, edge[1] or HOUR, **more)
    return rounded(found, "expected", digits=6)


def state_sql(source: str, keys: str, failed: str = "", ended: str = "", resets: str = "", resolution: int | None = None) -> str:
    """The rules over N(keys, ts_ms, observed), which source ends with. failed: a table of spans a, b; ended: a condition on
    the keys; resets: a table of (keys, ts_ms)."""
    o, w = f"PARTITION BY {keys} ORDER BY ts_ms", f"PARTITION BY {keys}"
    near = cadence.NEAR
    frames = {"p": f"{o} ROWS BETWEEN {near} PRECEDING AND 1 PRECEDING", "a": f"{o} ROWS BETWEEN 1 FOLLOWING AND {near} FOLLOWING", "b": f"{o} ROWS BETWEEN {near - 1} PRECEDING AND CURRENT ROW", "w": w}
    sums = ", ".join(f"sum(kg) OVER w_{k} AS g_{k}, sum(kc) OVER w_{k} AS c_{k}, count(kg) OVER w_{k} AS n_{k}, count(kl) OVER w_{k} AS l_{k}" for k in frames)
    named = ", ".join(f"w_{k} AS ({f})" for k, f in frames.items())
    intervals = ", ".join(f"CASE WHEN n_{k} >= {1 if k == 'w' else 2} AND c_{k} > 0 THEN g_{k} / c_{k} END AS i_{k}" for k in frames)
    slows = ", ".join(f"coalesce(i_{k} > 1.25 * {HOUR} AND l_{k} >= 2, false) AS s_{k}" for k in frames)
    meets = f"EXISTS (SELECT 1 FROM {failed} f WHERE f.a < {{t}} AND f.b > {{t}} - {HOUR})" if failed else "false"
    known = "false" if resolution is None or resolution <= HOUR else f"coalesce(abs(mean * {HOUR} / (mean - 1) / {resolution} - 1) <= 0.05, false)"
    regular = "({lo} >= 4 AND {hi} - {lo} <= greatest(2.0, 0.25 * {lo}))"
    short = "observed < {e} - (greatest(1, {e} * 0.1) + 0.1)"
    fast, passes = "", 3
    for turn in range(passes):
        use = "use" if turn == 0 else f"use AND NOT ({short.format(e=f'fast{turn - 1}')})"
        fast += f", E{turn + 1} AS (SELECT *, greatest(CASE WHEN sum(CASE WHEN {use} THEN g2 END) OVER ({w}) > 0 THEN {HOUR} * sum(CASE WHEN {use} THEN observed END) OVER ({w}) / sum(CASE WHEN {use} THEN g2 END) OVER ({w}) ELSE typical END, least) AS fast{turn} FROM E{turn})"
    over = f"({ended})" if ended else "false"
    fell = f"EXISTS (SELECT 1 FROM {resets} r WHERE {' AND '.join(f'r.{k} = Z.{k}' for k in keys.split(', '))} AND r.ts_ms = Z.ts_ms)" if resets else "false"
    return f"""{source},
BND AS (SELECT min(ts_ms) - {HOUR} AS s, max(ts_ms) AS e FROM N),
NZ AS (SELECT {keys}, ts_ms, observed FROM N WHERE NOT {meets.format(t="N.ts_ms")}),
J1 AS (SELECT *, lag(ts_ms) OVER ({o}) AS prev, CAST(ts_ms - lag(ts_ms) OVER ({o}) AS DOUBLE) AS g, lead(ts_ms) OVER ({o}) IS NULL AS is_last FROM NZ),
J2 AS (SELECT *, quantile_cont(g, 0.5) OVER ({o} ROWS BETWEEN {near} PRECEDING AND {near} FOLLOWING) AS med, quantile_cont(observed, 0.5) OVER ({w}) AS typ FROM J1),
J3 AS (SELECT *, CASE WHEN g <= 2 * med THEN g END AS kg, CASE WHEN g <= 2 * med THEN observed END AS kc, CASE WHEN g <= 2 * med AND g > {HOUR} THEN 1 END AS kl FROM J2),
J4 AS (SELECT *, {sums} FROM J3 WINDOW {named}),
J5 AS (SELECT *, {intervals} FROM J4),
J6 AS (SELECT *, {slows}, coalesce(i_w, {HOUR} / greatest(1, typ)) AS plain, g / observed AS own FROM J5),
J7 AS (SELECT *, i_p IS NULL AND i_a IS NULL AS none, i_p IS NULL OR coalesce(i_a IS NOT NULL AND (own IS NULL OR abs(ln(i_a / own)) < abs(ln(i_p / own)) OR (abs(ln(i_a / own)) = abs(ln(i_p / own)) AND i_a < i_p)), false) AS aft FROM J6),
J8 AS (SELECT *, CASE WHEN none THEN plain WHEN aft THEN i_a ELSE i_p END AS i, CASE WHEN none THEN s_w WHEN aft THEN s_a ELSE s_p END AS slow, coalesce(i_b, plain) AS it, CASE WHEN i_b IS NULL THEN s_w ELSE s_b END AS slow_t FROM J7),
L AS (SELECT J8.*, unnest(generate_series(coalesce(prev + {HOUR}, s + {HOUR}), CASE WHEN is_last THEN e ELSE ts_ms END, {HOUR})) AS t FROM J8, BND),
R0 AS (SELECT {keys}, CAST(t AS BIGINT) AS ts_ms, CASE WHEN t = ts_ms THEN observed ELSE 0 END AS observed, CASE WHEN t = ts_ms THEN g END AS g, CASE WHEN t = ts_ms THEN med END AS med,
  CASE WHEN t > ts_ms THEN it ELSE i END AS i, CASE WHEN t > ts_ms THEN slow_t ELSE slow END AS slow, CASE WHEN t > ts_ms THEN ts_ms ELSE prev END AS ref0,
  prev IS NULL AND t < ts_ms AS absent, CASE WHEN t <= ts_ms THEN ts_ms END AS gap_end, t > ts_ms AS behind, {meets.format(t="L.t")} AS unk FROM L),
R1 AS (SELECT *, greatest(ref0, max(CASE WHEN unk THEN ts_ms END) OVER ({o} ROWS UNBOUNDED PRECEDING)) AS ref, observed > 0 AND NOT unk AS fullb, observed = 0 AND NOT unk AND NOT absent AS zero, NOT slow AND {HOUR} / i BETWEEN 0.8 AND 1.2 AS one FROM R0),
R2 AS (SELECT *, coalesce(lag(fullb) OVER ({o}), false) AND coalesce(lead(fullb) OVER ({o}), true) AS lone FROM R1),
R3 AS (SELECT *, CASE WHEN zero AND lone AND one THEN 'Z' WHEN fullb AND observed >= 2 AND one THEN 'T' WHEN (zero AND NOT lone) OR unk THEN 'X' END AS kind FROM R2),
EV AS (SELECT *, lag(kind) OVER ({o}) AS bef, lead(kind) OVER ({o}) AS nxt FROM R3 WHERE kind IS NOT NULL),
EV2 AS (SELECT *, sum(CASE WHEN kind = 'X' OR bef IS NULL OR bef = 'X' OR bef = kind THEN 1 ELSE 0 END) OVER ({o} ROWS UNBOUNDED PRECEDING) AS run, (bef IS NULL OR bef = 'X') AND kind = 'T' AS hidden FROM EV),
EV3 AS (SELECT *, max(CAST(hidden AS INT)) OVER (PARTITION BY {keys}, run) AS skip FROM EV2 WHERE kind <> 'X'),
EV4 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, run ORDER BY ts_ms) - skip AS place, count(*) OVER (PARTITION BY {keys}, run) - skip AS n FROM EV3),
EV5 AS (SELECT *, place >= 1 AND (place % 2 = 0 OR place < n) AS paired FROM EV4),
EV6 AS (SELECT *, coalesce(max(CAST(paired OR hidden AS INT)) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM EV5),
SP AS (SELECT {keys}, ts_ms, kind = 'Z' AND (paired OR (seen AND (nxt IS NULL OR nxt = 'X'))) AS sp FROM EV6),
R4 AS (SELECT R3.*, coalesce(sp, false) AS spilled FROM R3 LEFT JOIN SP USING ({keys}, ts_ms)),
SK AS (SELECT *, (ts_ms - lag(ts_ms) OVER ({o})) / {HOUR} AS d FROM R4 WHERE zero AND NOT spilled),
SK2 AS (SELECT *, CASE WHEN count(d) OVER l4 = 4 THEN {regular.format(lo="min(d) OVER l4", hi="max(d) OVER l4")} ELSE false END AS run4, quantile_cont(d, 0.25) OVER ({w}) AS q1, quantile_cont(d, 0.75) OVER ({w}) AS q3, count(d) OVER ({w}) AS nd, count(*) OVER ({w}) AS n,
  (max(ts_ms) OVER ({w}) - min(ts_ms) OVER ({w})) / {HOUR} / nullif(count(*) OVER ({w}) - 1, 0) AS mean FROM SK WINDOW l4 AS ({o} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
TW AS (SELECT {keys}, count(*) FILTER (fullb AND observed >= 2) AS twos FROM R4 GROUP BY ALL),
SK3 AS (SELECT SK2.*, bool_or(run4) OVER ({o} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS cover FROM SK2),
SK4 AS (SELECT {keys}, ts_ms, NOT slow AND cover AND coalesce({regular.format(lo="q1", hi="q3")}, false) AND nd >= 4 AND 2 * twos <= n AS cad0, NOT {known} AS unsure FROM SK3 JOIN TW USING ({keys})),
R5 AS (SELECT R4.*, coalesce(cad0, false) AS cad, coalesce(cad0 AND unsure, false) AS undet FROM R4 LEFT JOIN SK4 USING ({keys}, ts_ms)),
R6 AS (SELECT *, CASE WHEN slow THEN coalesce(ts_ms - ref > greatest(1.5 * i, i + {HOUR}), true) ELSE NOT spilled END AND NOT cad AS missed FROM R5),
R7 AS (SELECT *, g - {HOUR} * count(CASE WHEN zero AND (missed OR undet) AND NOT slow THEN 1 END) OVER (PARTITION BY {keys}, gap_end) AS g2 FROM R6),
E0 AS (SELECT *, coalesce(fullb AND NOT slow AND g2 <= 2 * med, false) AS use, CASE WHEN bool_or(cad AND NOT undet) OVER ({w}) THEN 0.8 ELSE 1.0 END AS least, quantile_cont(CASE WHEN fullb THEN observed END, 0.5) OVER ({w}) AS typical, bool_or(slow) OVER ({w}) AS by_gap FROM R7){fast},
X0 AS (SELECT *, CASE WHEN slow THEN {HOUR} / i ELSE fast{passes - 1} END AS expected0, CASE WHEN fullb THEN CASE WHEN by_gap THEN observed * {HOUR} / g ELSE observed END END AS r FROM E{passes}),
H AS (SELECT {keys}, ts_ms, r, row_number() OVER ({o}) - 1 >= count(*) OVER ({w}) // 2 AS late FROM X0 WHERE r IS NOT NULL),
HS AS (SELECT {keys}, avg(r) FILTER (NOT late) AS me, avg(r) FILTER (late) AS ml, quantile_cont(r, 0.25) FILTER (NOT late) AS e1, quantile_cont(r, 0.5) FILTER (NOT late) AS e2, quantile_cont(r, 0.75) FILTER (NOT late) AS e3,
  quantile_cont(r, 0.25) FILTER (late) AS l1, quantile_cont(r, 0.5) FILTER (late) AS l2, quantile_cont(r, 0.75) FILTER (late) AS l3, count(*) FILTER (NOT late) AS ne, count(*) FILTER (late) AS nl, greatest(quantile_cont(r, 0.5), 1e-9) AS base FROM H GROUP BY {keys}),
HC AS (SELECT *, abs(ln(l2 / base)) >= abs(ln(e2 / base)) AS odd_late FROM HS WHERE ne >= 3 AND nl >= 3 AND greatest(me, ml) >= 2 * least(me, ml) AND CASE WHEN ml >= me THEN l1 > e3 ELSE e1 > l3 END),
HB AS (SELECT H.{keys.split(", ")[0]}{"".join(f", H.{k}" for k in keys.split(", ")[1:])}, min(ts_ms) AS lo, max(ts_ms) AS hi FROM H JOIN HC USING ({keys}) WHERE late = odd_late GROUP BY ALL),
Y AS (SELECT X0.*, coalesce(X0.ts_ms BETWEEN lo AND hi, false) AS changed, CASE WHEN unk OR undet THEN 4 WHEN absent THEN 3 WHEN observed = 0 THEN CASE WHEN missed THEN 2 ELSE 0 END WHEN slow THEN 0 WHEN {short.format(e="expected0")} THEN 1 ELSE 0 END AS state0 FROM X0 LEFT JOIN HB USING ({keys})),
Z AS (SELECT *, CASE WHEN state0 = 2 AND behind AND {over} THEN 5 ELSE state0 END AS state FROM Y),
Q AS (SELECT *, max(CASE WHEN state IN (2, 4) THEN ts_ms END) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_t, {fell} AS fell FROM Z),
ST AS (SELECT {keys}, ts_ms, CAST(CASE WHEN unk OR undet THEN 0 ELSE observed END AS DOUBLE) AS observed, round(CASE WHEN unk OR undet THEN 0 ELSE expected0 END, 6) AS expected, state,
  (CASE WHEN undet THEN 32 ELSE 0 END) + (CASE WHEN changed THEN 2 ELSE 0 END) + (CASE WHEN state = 5 THEN 4 ELSE 0 END) + (CASE WHEN fell THEN 1 ELSE 0 END) + (CASE WHEN state NOT IN (2, 3, 4) AND ts_ms - gap_t <= {HOUR} THEN 16 ELSE 0 END) AS flags FROM Q)"""


_ALL = "SELECT {keys}, ts_ms, observed, expected, CAST(state AS INTEGER) AS state, CAST(flags AS INTEGER) AS flags FROM ST"
_OUT = "FS AS (SELECT ts_ms AS a, ts_ms + 10800000 AS b FROM S WHERE event_id % 2000 = 0)"
_N1 = f"{C}, {_OUT}, RB AS (SELECT event_type, {end(HOUR)} AS ts_ms FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms) AS p FROM C) WHERE value < p GROUP BY ALL), N AS (SELECT event_type, {end(HOUR)} AS ts_ms, CAST(count(*) AS DOUBLE) AS observed FROM S GROUP BY ALL)"
_N2 = f"{S}, N AS (SELECT event_type, instance, {end(HOUR)} AS ts_ms, CAST(count(*) AS DOUBLE) AS observed FROM S GROUP BY ALL)"


def _scrape_sql(every: int, jitter: bool) -> str:
    at = f"{_ZERO} + n * {every}" + (" + CAST(floor(value) AS BIGINT) % 3 - 1" if jitter else "")
    return f"{G}, SC AS (SELECT event_type, value, {at} AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) AS n FROM G) WHERE value >= 2), N AS (SELECT event_type, {end(HOUR)} AS ts_ms, CAST(count(*) AS DOUBLE) AS observed FROM SC GROUP BY ALL)"


def plain_states(s: SparkSession, d: str) -> DataFrame:
    return states(counts(src.samples(s, d), KEY), KEY, failed=outages(s, d), resets=discovery.reset_buckets(src.counter(s, d), KEY, HOUR))


_ST1 = state_sql(_N1, "event_type", failed="FS", resets="RB")
register("bucket_state_cadence", f"WITH {_ST1} {_ALL.format(keys='event_type')}")(plain_states)


def slow_states(s: SparkSession, d: str) -> DataFrame:
    ended = src.samples(s, d).filter(F.col("instance") % 2 == 0).select(*_BOTH)
    return states(counts(src.samples(s, d), _BOTH), _BOTH, ended=ended)


register("bucket_state_slow_series", f"WITH {state_sql(_N2, 'event_type, instance', ended='instance % 2 = 0')} {_ALL.format(keys='event_type, instance')}")(slow_states)
for _name, _resolution in (("bucket_state_skipping", None), ("bucket_state_skipping_known", SIXTY_SIX)):
    register(_name, f"WITH {state_sql(_scrape_sql(SIXTY_SIX, False), 'event_type', resolution=_resolution)} {_ALL.format(keys='event_type')}")(lambda s, d, r=_resolution: states(counts(scraped(s, d, SIXTY_SIX, False), KEY), KEY, resolution=r))
register("bucket_state_spilled", f"WITH {state_sql(_scrape_sql(HOUR, True), 'event_type')} {_ALL.format(keys='event_type')}")(lambda s, d: states(counts(scraped(s, d, HOUR, True), KEY), KEY))
register("settle_unobserved", f"WITH {_ST1}, V AS (SELECT event_type, {end(HOUR)} AS ts_ms, avg(value) AS v FROM S GROUP BY ALL) SELECT event_type, ts_ms, CAST(state AS INTEGER) AS state, round(CASE WHEN state IN (0, 1) THEN v WHEN state = 2 THEN coalesce(v, 0) END, 7) AS value FROM ST LEFT JOIN V USING (event_type, ts_ms)")(
    lambda s, d: rounded(cadence.settle_unobserved(src.buckets(s, d, HOUR).select("event_type", "ts_ms", F.col("avg").alias("value")), plain_states(s, d), KEY, "value"), "value")
)
register("post_gap_reach", f"WITH {_ST1}, GP AS (SELECT *, max(CASE WHEN state IN (2, 4) THEN ts_ms END) OVER (PARTITION BY event_type ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_t FROM ST) SELECT event_type, ts_ms FROM GP WHERE state NOT IN (2, 3, 4) AND ts_ms - gap_t <= {SIX}")(
    lambda s, d: states(counts(src.samples(s, d), KEY), KEY, failed=outages(s, d), post_gap=cadence.post_gap_buckets(SIX, HOUR)).filter(F.col("flags").bitwiseAND(16) > 0).select("event_type", "ts_ms")
)

# --- spans: as of a time, and by range ---
_SPAN = f"{S}, SP AS (SELECT event_type, ts_ms AS a, ts_ms + CAST(floor(value * value) AS BIGINT) * {HOUR} AS b FROM S WHERE event_id % 50 = 0)"


def long_spans(s: SparkSession, d: str) -> DataFrame:
    """Spans from nothing to more than a year."""
    return src.samples(s, d).filter(F.col("event_id") % 50 == 0).select("event_type", F.col("ts_ms").alias("a"), (F.col("ts_ms") + F.floor(F.col("value") * F.col("value")) * HOUR).alias("b"))


register("spans_merged", f"WITH {_SPAN}, M AS (SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM SP WHERE b > a), I AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM M) SELECT event_type, min(a) AS a, max(b) AS b FROM I GROUP BY event_type, i")(lambda s, d: spans.merged(long_spans(s, d), KEY))
register("as_of_last_fact", f"WITH {_SPAN} SELECT event_id, S.event_type, ts_ms, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM S ASOF LEFT JOIN (SELECT event_type, a, max(b) AS b FROM SP GROUP BY ALL) f ON S.event_type = f.event_type AND S.ts_ms >= f.a")(
    lambda s, d: spans.as_of(src.samples(s, d).select("event_id", "event_type", "ts_ms"), long_spans(s, d).withColumn("since", F.col("a")), KEY, "ts_ms", "since", ["a", "b"]).na.fill(-1, ["a", "b"])
)
register("range_join", f"WITH {_SPAN}, RG AS (SELECT event_id, event_type, ts_ms AS low, ts_ms + 1 + CAST(floor(value) AS BIGINT) * 60000 AS high FROM S WHERE event_id % 20 = 1) SELECT event_id, RG.event_type, a, b, count(*) AS n FROM RG JOIN SP ON RG.event_type = SP.event_type AND low < b AND a < high AND b > a GROUP BY ALL")(
    lambda s, d: spans.overlaps_counted(src.samples(s, d).filter("event_id % 20 = 1").select("event_id", "event_type", F.col("ts_ms").alias("low"), (F.col("ts_ms") + 1 + F.floor("value") * 60_000).alias("high")), long_spans(s, d), ["event_id"], "low", "high", KEY)
)
