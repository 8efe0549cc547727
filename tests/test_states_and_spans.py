"""Bucket states, spans, quantiles, roles and cycles where the rules matter more than the tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import registry
from tidegauge.functions.quantiles import quantiles
from tidegauge.operators import cadence, cycles, metric_histograms, roles, spans, state

MIN = 60_000


def states(spark, times, step=MIN, end=None, **more):
    rows = spark.createDataFrame([("s", t) for t in times], "k string, t long")
    counts = rows.groupBy("k", (F.ceil(F.col("t") / step) * step).cast("long").alias("ts_ms")).agg(F.count("*").alias("observed"))
    found = cadence.by_cadence(counts, ["k"], step, 0, end or max(times), **more).orderBy("ts_ms").collect()
    return [(r["ts_ms"] // step, r["state"], r["flags"]) for r in found]


def test_a_lost_scrape_at_the_steps_rate_is_empty_and_the_next_bucket_follows_a_gap(spark):
    found = states(spark, [i * MIN for i in range(1, 41) if i not in (20, 30, 31)])
    assert [b for b, s, _ in found if s == state.EMPTY] == [20, 30, 31] and [b for b, _, f in found if f & state.POST_GAP] == [21, 32]


def test_a_slower_series_keeps_its_cadence(spark):
    """A scrape every third bucket: the two between are no misses; a lost one is."""
    found = states(spark, [i * 3 * MIN for i in range(1, 31) if i != 15])
    empty = [b for b, s, _ in found if s == state.EMPTY]
    assert empty and set(empty) <= {44, 45, 46, 47} and all(s != state.PARTIAL for _, s, _ in found)


def test_a_fast_series_that_loses_samples_is_partial(spark):
    times = [i * 6_000 for i in range(1, 401) if not (200 <= i < 300 and i % 2)]
    found = states(spark, times)
    assert {b for b, s, _ in found if s == state.PARTIAL} >= set(range(22, 30)) and found[0][1] == state.OK


def test_before_the_first_sample_a_series_is_absent_and_after_a_marker_its_silence_is_suspect(spark):
    times = [i * MIN for i in range(10, 21)]
    ended = spark.createDataFrame([("s",)], "k string")
    found = states(spark, times, end=25 * MIN, ended=ended)
    assert [s for b, s, _ in found if b < 10] == [state.ABSENT] * 9 and [(s, f & cadence.STALE_MARKER) for b, s, f in found if b > 20] == [(state.SUSPECT, cadence.STALE_MARKER)] * 5
    assert [s for b, s, _ in states(spark, times, end=25 * MIN) if b > 20] == [state.EMPTY] * 5


def test_failed_spans_are_unknown(spark):
    failed = spark.createDataFrame([(5 * MIN, 7 * MIN), (6 * MIN, 8 * MIN)], "a long, b long")
    found = states(spark, [i * MIN for i in range(1, 21)], failed=failed)
    assert [b for b, s, _ in found if s == state.UNKNOWN] == [6, 7, 8]


def test_a_change_of_the_interval_is_flagged(spark):
    times = [i * 30_000 for i in range(1, 41)] + [20 * MIN + i * 10_000 for i in range(1, 121)]
    found = states(spark, times)
    assert {f & cadence.INTERVAL_CHANGE for _, _, f in found} == {0, cadence.INTERVAL_CHANGE}


def test_range_join_equals_brute_force_and_lays_no_span_out(spark):
    rng = np.random.default_rng(1)
    lows = rng.integers(0, 10**9, 120)
    left = [(int(i), int(a), int(a + 10 ** rng.integers(0, 10))) for i, a in enumerate(lows)]
    right = [(int(i), int(a), int(a + 10 ** rng.integers(0, 12)) if i % 9 else int(a)) for i, a in enumerate(rng.integers(-(10**8), 10**9, 90))]
    rows = spark.createDataFrame(left, "i long, low long, high long").withColumn("k", F.col("i") % 2)
    held = spark.createDataFrame(right, "j long, a long, b long").withColumn("k", F.col("j") % 2)
    got = sorted((r["i"], r["j"]) for r in spans.containing(rows, held, ["k"], "low", "high").collect())
    assert got == sorted((i, j) for i, x, y in left for j, a, b in right if i % 2 == j % 2 and x < b and a < y and b > a)
    year = spark.createDataFrame([(0, 0, 365 * 86_400_000)], "k long, a long, b long")
    one = spark.createDataFrame([(0, 5_000, 6_000)], "k long, low long, high long")
    assert spans.containing(one, year, ["k"], "low", "high").count() == 1


@pytest.mark.parametrize("weibull", [False, True])
def test_quantiles_from_counts(spark, weibull):
    x = np.round(np.random.default_rng(2).normal(size=501), 1)
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 4.0), ("c", float("nan")), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in quantiles(rows, ["k"], "v", {"p": 0.05, "q": 0.5, "r": 0.99}, weibull=weibull).collect()}
    want = np.quantile(x, [0.05, 0.5, 0.99], method="weibull" if weibull else "linear")
    assert set(got) == {"a", "b"} and got["b"]["q"] == 4.0 and np.allclose([got["a"][c] for c in "pqr"], want)


def test_histograms_refuse_what_is_none(spark):
    row = lambda **labels: spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in labels.items()])).alias("labels"), F.lit(1000).cast("long").alias("ts_ms"), F.lit(1.0).alias("value"))
    with pytest.raises(ValueError, match="neither"):
        metric_histograms.fetch(row(job="a"), ["job"], 1000)
    with pytest.raises(ValueError, match="several forms"):
        metric_histograms.fetch(row(job="a", le="1").union(row(job="a", vmrange="1...2")), ["job"], 1000)
    unlike = row(job="a", i="1", le="1").union(row(job="a", i="1", le="+Inf")).union(row(job="a", i="2", le="+Inf"))
    with pytest.raises(ValueError, match="different bucket edges"):
        metric_histograms.fetch(unlike, ["job"], 1000)
    assert metric_histograms.fetch(unlike, ["job", "i"], 1000).rows.count() == 0


def test_littles_law_sees_a_leak(spark):
    """What is counted inside is twice what arrivals and times give, on one day of four."""
    noise = np.random.default_rng(3).normal(1, 0.02, 96)
    rows = [("g", (i + 1) * MIN, 2.0, 2.0 * 60 * 3, 120.0, float(6 * noise[i] * (2 if 48 <= i < 72 else 1))) for i in range(96)]
    aligned = spark.createDataFrame(rows, "k string, ts_ms long, arrivals double, spent double, done double, inside double")
    found = roles.windows(aligned, ["k"], MIN, 24, 6, 0)
    assert {(r["grid"], r["window"]) for r in found.filter("verdict = 'L_high'").collect()} >= {(0, 2)} and found.filter("grid = 0 AND verdict = 'consistent'").count() == 3
    judged = roles.judged(found, ["k"]).first()
    assert (judged["verdict"], judged["off"], judged["shifted_only"]) == ("inconsistent_in_windows", 1, 0)


def test_a_cycle_that_does_not_belong_goes(spark):
    levels = spark.createDataFrame([("a", v, 1e-4) for v in (0.0, 0.1, -0.1, 0.05, -0.05, 0.02, 4.0)] + [("b", v, 1e-4) for v in (0.0, 9.0)], "k string, l double, v double")
    got = {r["k"]: (r["low"], r["high"]) for r in cycles.kept_cycles(levels, ["k"], "l", F.sqrt(F.avg("v"))).collect()}
    assert got == {"a": (-0.1, 0.1), "b": (0.0, 9.0)}


def test_no_window_of_the_states_is_summed_anew_for_each_row(spark):
    """A frame from a row to the end of its series costs the square of the series."""
    counts = spark.createDataFrame([("s", i * MIN, 1.0) for i in range(1, 9)], "k string, ts_ms long, observed double")
    plan = cadence.by_cadence(counts, ["k"], MIN, 0, 8 * MIN)._jdf.queryExecution().analyzed().toString()
    assert "RowFrame, -16" in plan and not re.findall(r"(?:Row|Range)Frame, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan)


def test_overlaps_are_counted_where_they_meet(spark, monkeypatch):
    """Copies, ids with several ranges and slots in parts; no pair of the registered query goes through an aggregation."""
    monkeypatch.setattr(spans, "SLOT_ROWS", 3)
    rng = np.random.default_rng(4)
    left = [(int(i % 40), "k", int(x), int(x + n)) for i, (x, n) in enumerate(zip(rng.integers(0, 10**6, 60), rng.integers(0, 10**5, 60), strict=True))]
    right = [("k", int(x), int(x + n)) for x, n in zip(rng.integers(0, 10**6, 50), rng.integers(-10, 10**9, 50), strict=True)]
    left, right = left + left[:25] + left[45:50], right + right[:20]
    rows, held = spark.createDataFrame(left, "i long, k string, low long, high long"), spark.createDataFrame(right, "k string, a long, b long")
    got = spans.overlaps_counted(rows, held, ["i"], "low", "high", ["k"]).collect()
    want = Counter((i, a, b) for i, _, x, y in left for _, a, b in right if x < y and a < b and x < b and a < y)
    assert len(got) == len(want) and {(r["i"], r["a"], r["b"]): r["n"] for r in got} == want
    plan = registry.queries()["range_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_pairs_of_long_spans_take_little_disk(spark, tmp_path):
    """Spans over all times: pairs are written part by part, where ids repeat; before, they took more than a byte each."""
    ranges = spark.range(6_000).select("id", F.lit("k").alias("k"), (F.xxhash64("id") % 10**9).alias("low")).withColumn("high", F.col("low") + 1 + F.col("id") % 60_000)
    held = spark.range(300).select(F.lit("k").alias("k"), (-2 * 10**9 - F.xxhash64("id") % 10**9).alias("a"), (3 * 10**9 + F.xxhash64(-F.col("id")) % 10**9).alias("b"))
    spans.overlaps_counted(ranges, held, ["id"], "low", "high", ["k"]).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 6_000 * 300 and got.agg(F.sum("n")).first()[0] == 6_000 * 300
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * 6_000 * 300


@pytest.mark.parametrize("rows_of_part", [2, 7, 1_024])
def test_parts_of_rows_meet_every_span_once(spark, monkeypatch, rows_of_part):
    """Ranges of all lengths, many of one time or alike, and spans that begin or end where ranges and parts do."""
    monkeypatch.setattr(spans, "SLOT_ROWS", rows_of_part)
    rng = np.random.default_rng(5)
    lows, ends = rng.integers(-50, 50, 90) * MIN, 10 ** rng.integers(0, 9, 90)
    left = [(i, "ab"[i % 2] if i % 11 else None, int(x), int(x + n)) for i, (x, n) in enumerate(zip(lows, ends, strict=True))]
    right = [(j, "ab"[j % 2], int(x), int(x + n)) for j, (x, n) in enumerate(zip(rng.integers(-60, 60, 70) * MIN, rng.integers(-1, 40, 70) * MIN, strict=True))]
    rows, held = spark.createDataFrame(left, "i long, k string, low long, high long"), spark.createDataFrame(right, "j long, k string, a long, b long")
    met = spans.containing(rows, held, ["k"], "low", "high")
    assert met.columns == ["k", "i", "low", "high", "j", "a", "b"]
    got = sorted((r["i"], r["j"]) for r in met.collect())
    assert got == sorted((i, j) for i, k, x, y in left for j, h, a, b in right if k == h and a < b and x < b and a < y)
