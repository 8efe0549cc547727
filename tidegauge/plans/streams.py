"""Streams over files that grow: each query lets its stream run twice over events in two parts, from its checkpoint, and gives
what has come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidegauge.functions.timegrid import bucket_end
from tidegauge.plans.catalogue import DAY, HOUR, S, end, rounded
from tidegauge.plans.shapes import CUSUM, standard
from tidegauge.registry import register
from tidegauge.session import make_importable
from tidegauge.sources import events as src
from tidegauge.streaming import chunks, detectors, feed, rollup, runs

_HALF = ["__first", "NOT __first"]


def _halved(rows: DataFrame, time: str) -> DataFrame:
    """rows with __first: do they lie in the first half of the table's time?"""
    edge = rows.agg(F.min(time), F.max(time)).first()
    return rows.withColumn("__first", F.col(time) <= ((edge[0] or 0) + (edge[1] or 0)) // 2)


def _twice(s: SparkSession, rows: DataFrame, time: str, start: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Two runs over the parts of rows; start(stream, work folder) gives a writer. The work folder."""
    work = runs.work_dir(s, "stream")
    halved = _halved(rows, time)
    runs.in_parts(halved, f"{work}/in", _HALF, lambda: runs.run_now(start(s.readStream.schema(halved.schema).parquet(f"{work}/in"), work), f"{work}/state"))
    return work


def final_buckets(s: SparkSession, d: str) -> DataFrame:
    """Hourly buckets that can change no more; the rest wait for the watermark."""
    rows = src.samples(s, d).select("event_type", "ts_ms", F.timestamp_millis("ts_ms").alias("ts"), "value")
    work = _twice(s, rows, "ts_ms", lambda stream, at: rollup.rollup(stream, ["event_type"], HOUR).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out"))
    return rounded(s.read.parquet(f"{work}/out").select("event_type", "ts_ms", "avg", "min", "max", "count"), "avg")


register("stream_final_buckets", f"WITH {S}, FB AS (SELECT event_type, {end(HOUR)} AS ts_ms, round(avg(value), 7) AS avg, min(value) AS min, max(value) AS max, count(value) AS count FROM S GROUP BY ALL) SELECT * FROM FB WHERE ts_ms <= (SELECT max(ts_ms) - 1 - 300000 FROM S)")(final_buckets)


def live_signals(s: SparkSession, d: str) -> DataFrame:
    """CUSUM signals of standardised hours; the second run goes on with the state that the first one left."""
    make_importable(s)
    rows = standard(s, d).select("event_type", "ts_ms", F.col("z").cast("double").alias("value"))
    work = _twice(s, rows, "ts_ms", lambda stream, at: detectors.cusum(stream, "event_type", 0.0, 1.0, HOUR).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out"))
    return rounded(s.read.parquet(f"{work}/out"), "up", "down", digits=6)


register("stream_cusum", CUSUM)(live_signals)

# --- answers to chunks of a day, asked for up to four times ---
_CHUNK = ["event_type", "day"]


def answer_rows(s: SparkSession, d: str) -> DataFrame:
    """The v-th answer about a day counts the events with event_id % 4 <= v; some are complete, most are not."""
    rows = src.samples(s, d).select("event_type", bucket_end(F.col("ts_ms"), DAY).alias("day"), bucket_end(F.col("ts_ms"), HOUR).alias("ts_ms"), "event_id")
    asked = rows.withColumn("fetched_at", F.explode(F.sequence(F.col("event_id") % 4, F.lit(3).cast("long"))))
    counted = asked.groupBy(*_CHUNK, "ts_ms", "fetched_at").agg(F.count("*").alias("n"))
    return counted.withColumn("complete", (F.floor(F.col("day") / DAY) + F.col("fetched_at")) % 5 == 0)


_AN = f"{S}, AN AS (SELECT event_type, {end(DAY)} AS day, {end(HOUR)} AS ts_ms, v AS fetched_at, count(*) AS n, ({end(DAY)} // {DAY} + v) % 5 = 0 AS complete FROM S JOIN (VALUES (0), (1), (2), (3)) a(v) ON event_id % 4 <= v GROUP BY ALL), WN AS (SELECT event_type, day, max(CASE WHEN complete THEN fetched_at END) AS c, max(fetched_at) AS m FROM AN GROUP BY ALL)"


def _answers(s: SparkSession, d: str) -> DataFrame:
    """All answers, in the order of asking, and the last ones a second time."""
    work = runs.work_dir(s, "stream")
    rows = answer_rows(s, d)
    start = lambda: runs.run_now(chunks.keep(s.readStream.schema(rows.schema).parquet(f"{work}/in"), f"{work}/out"), f"{work}/state")
    runs.in_parts(rows, f"{work}/in", ["fetched_at < 2", "fetched_at >= 2", "fetched_at = 3"], start)
    return chunks.answers(s, f"{work}/out")


register("stream_chunk_answers", f"WITH {_AN} SELECT event_type, day, ts_ms, fetched_at, CAST(complete AS INTEGER) AS complete, n FROM AN JOIN WN USING (event_type, day) WHERE fetched_at = coalesce(c, m)")(lambda s, d: chunks.current(_answers(s, d), _CHUNK).withColumn("complete", F.col("complete").cast("int")))
register("stream_unknown_after", f"WITH {_AN} SELECT event_type, day, CAST(c - 1 AS BIGINT) AS a FROM WN WHERE c < m")(lambda s, d: chunks.unknown_after(_answers(s, d), _CHUNK, 1))


# --- events to two consumers ---
def delivered(s: SparkSession, d: str) -> DataFrame:
    """Purchases are intentional, clicks ambient, all else internal; scopes are the instances."""
    make_importable(s)
    klass = F.when(F.col("event_type") == "purchase", feed.INTENTIONAL).when(F.col("event_type") == "click", feed.AMBIENT).otherwise(feed.INTERNAL)
    rows = src.samples(s, d).select(F.col("instance").alias("scope"), F.col("event_id").alias("seq"), klass.alias("klass"))
    with runs.rocks(s):
        work = _twice(s, rows, "seq", lambda stream, at: feed.deliver(stream, ["agent", "log"]).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out"))
    return s.read.parquet(f"{work}/out").groupBy("consumer", "scope", "seq", "klass").agg(F.count("*").alias("times"))


register("stream_feed", f"WITH {S}, EV AS (SELECT instance AS scope, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'intentional' ELSE 'ambient' END AS klass FROM S WHERE event_type IN ('purchase', 'click')), UP AS (SELECT scope, max(seq) AS up_to FROM EV WHERE klass = 'intentional' GROUP BY scope) SELECT consumer, scope, seq, klass, 1::BIGINT AS times FROM EV JOIN UP USING (scope), (VALUES ('agent'), ('log')) c(consumer) WHERE seq <= up_to")(delivered)
