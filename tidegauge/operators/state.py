"""Completeness of buckets: what was observed against what was expected. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.timegrid import bucket_end

OK, PARTIAL, EMPTY, ABSENT, UNKNOWN, SUSPECT = range(6)
POST_GAP = 16


def presence(samples: DataFrame, keys: list[str], step: int, start: int, end: int, failed: list[tuple[int, int]] | None = None) -> DataFrame:
    """observed, expected, state and flags on the grid (start, end] of each series. A series expects its own median
    count; it is ABSENT before its first sample; buckets that overlap a failed span are UNKNOWN and expect nothing."""
    counts = samples.groupBy(*keys, bucket_end(F.col("ts_ms"), step).alias("ts_ms")).agg(F.count("*").cast("double").alias("observed"))
    return of_counts(counts, keys, step, start, end, failed)


def of_counts(counts: DataFrame, keys: list[str], step: int, start: int, end: int, failed: list[tuple[int, int]] | None = None) -> DataFrame:
    """presence() from the samples of each bucket, (keys, ts_ms, observed), where a dataset holds them already."""
    series = counts.groupBy(*keys).agg(F.min("ts_ms").alias("first"), F.percentile("observed", F.lit(0.5)).alias("usual"))
    grid = series.withColumn("ts_ms", F.explode(F.sequence(F.lit(start + step), F.lit(end), F.lit(step)).cast("array<bigint>")))
    rows = grid.join(counts, [*keys, "ts_ms"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    unknown = F.lit(False)
    for a, b in failed or []:
        unknown = unknown | ((F.col("ts_ms") > a) & (F.col("ts_ms") - step < b))
    absent = F.col("ts_ms") < F.col("first")
    state = F.when(unknown, UNKNOWN).when(absent, ABSENT).when(F.col("observed") == 0, EMPTY).when(F.col("observed") < F.col("usual") - (F.greatest(F.lit(1.0), F.col("usual") * 0.1) + 0.1), PARTIAL).otherwise(OK)
    rows = rows.select(*keys, "ts_ms", F.when(unknown, 0.0).otherwise(F.col("observed")).alias("observed"), F.when(unknown | absent, 0.0).otherwise(F.col("usual")).alias("expected"), state.alias("state"))
    before = F.lag("state").over(Window.partitionBy(*keys).orderBy("ts_ms"))
    after_gap = before.isin(EMPTY, UNKNOWN) & F.col("state").isin(OK, PARTIAL)
    return rows.withColumn("flags", F.when(F.coalesce(after_gap, F.lit(False)), POST_GAP).otherwise(0))


def coarsen(states: DataFrame, keys: list[str], step: int) -> DataFrame:
    """States of a coarser step: sums over what is not absent, flags joined; unknown if any part is, absent if all are."""
    alive = F.col("state") != ABSENT
    rows = states.groupBy(*keys, bucket_end(F.col("ts_ms"), step).alias("ts_ms")).agg(
        F.sum(F.when(alive, F.col("observed")).otherwise(0.0)).alias("observed"), F.sum(F.when(alive, F.col("expected")).otherwise(0.0)).alias("expected"), F.bit_or("flags").alias("flags"),
        F.max((F.col("state") == UNKNOWN).cast("int")).alias("u"), F.min((~alive).cast("int")).alias("a"),
    )
    state = F.when(F.col("u") == 1, UNKNOWN).when(F.col("a") == 1, ABSENT).when((F.col("observed") == 0) & (F.col("expected") > 0), EMPTY).when(F.col("observed") < F.col("expected") - (F.greatest(F.lit(1.0), F.col("expected") * 0.1) + 0.1), PARTIAL).otherwise(OK)
    return rows.select(*keys, "ts_ms", "observed", "expected", state.alias("state"), "flags")


def merge_group(states: DataFrame, member: str) -> DataFrame:
    """Members' states to a group's: alive, reporting, sums, and the sorted names of silent members."""
    alive = F.col("state") != ABSENT
    reporting = F.col("state").isin(OK, PARTIAL)
    return states.groupBy("ts_ms").agg(
        F.count_if(alive).alias("alive"), F.count_if(reporting).alias("reporting"), F.sum(F.when(alive, F.col("observed")).otherwise(0.0)).alias("observed"), F.sum(F.when(alive, F.col("expected")).otherwise(0.0)).alias("expected"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == EMPTY, F.col(member)))), ",").alias("silent"),
    )
