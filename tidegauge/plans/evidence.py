"""Cover of claims by evidence, both made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import evidence
from tidegauge.plans.catalogue import DAY, HOUR, KEY, S, rounded
from tidegauge.registry import register
from tidegauge.sources import events as src

_CL = f"""{S}, CL AS (SELECT event_type, event_id AS claim, ts_ms AS low, ts_ms + 2 * {DAY} AS high FROM S WHERE event_id % 10 = 7),
EV AS (SELECT event_type, ts_ms AS a, ts_ms + CAST(floor(value) AS BIGINT) * {HOUR} AS b FROM S WHERE event_id % 20 = 3),
MG AS (SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM EV WHERE b > a),
MI AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM MG),
ME AS (SELECT event_type, min(a) AS a, max(b) AS b FROM MI GROUP BY event_type, i),
PT AS (SELECT event_type, claim, low, high, greatest(a, low) AS a, least(b, high) AS b FROM CL JOIN ME USING (event_type) WHERE a < high AND b > low)"""


def both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = src.samples(s, d)
    claims = rows.filter("event_id % 10 = 7").select("event_type", F.col("event_id").alias("claim"), F.col("ts_ms").alias("low"), (F.col("ts_ms") + 2 * DAY).alias("high"))
    return claims, rows.filter("event_id % 20 = 3").select("event_type", F.col("ts_ms").alias("a"), (F.col("ts_ms") + F.floor("value") * HOUR).alias("b"))


register("evidence_cover", f"WITH {_CL}, CV AS (SELECT event_type, claim, sum(b - a) AS covered FROM PT GROUP BY ALL) SELECT event_type, claim, low, high, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(coalesce(covered, 0) / (high - low), 7) AS share, CASE WHEN covered = high - low THEN 'whole' WHEN covered > 0 THEN 'partly' ELSE 'bare' END AS verdict FROM CL LEFT JOIN CV USING (event_type, claim)")(lambda s, d: rounded(evidence.cover(*both(s, d), KEY, "claim"), "share"))
register("evidence_bare", f"WITH {_CL}, AL AS (SELECT * FROM PT UNION ALL SELECT event_type, claim, low, high, high, high FROM CL), LG AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY event_type, claim ORDER BY a, b), low) AS f FROM AL) SELECT event_type, claim, f AS a, a AS b FROM LG WHERE a > f")(lambda s, d: evidence.bare(*both(s, d), KEY, "claim"))
