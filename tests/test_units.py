import pytest
from pyspark.sql import functions as F

from tidegauge.functions import ieee
from tidegauge.functions.timegrid import duration
from tidegauge.operators import buckets


def test_duration():
    assert duration("1h30m") == 5_400_000
    assert duration("250ms") == 250 and duration("1w2d") == 9 * 86_400_000
    for wrong in ("1x", "", "h", "1", "1m1h", "2h2h", "-1s", " 1s"):
        with pytest.raises(ValueError):
            duration(wrong)


def test_percentiles_are_never_merged():
    with pytest.raises(ValueError):
        buckets.check_mergeable("quantile", "avg")
    buckets.check_mergeable("sum", "sum")


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (6.0, 3.0), (1.0, -0.0), (-1.0, -0.0)], "a double, b double")
    assert [r[0] for r in df.select(ieee.div(F.col("a"), F.col("b"))).collect()] == [float("inf"), float("-inf"), 2.0, float("-inf"), float("inf")]


def test_rebucket_with_unknown_counts_and_nan_members(spark):
    nan = float("nan")
    rows = [
        (1, "known", 10.0, 8.0, 12.0, 5), (2, "known", 40.0, 1.0, 41.0, 15),
        (1, "unknown", 10.0, 8.0, 12.0, 5), (2, "unknown", 40.0, 1.0, 41.0, None),
        (1, "nan", nan, nan, nan, 7), (2, "nan", nan, nan, nan, 2),
        (1, "mixed", nan, nan, nan, 7), (2, "mixed", 6.0, 5.0, 9.0, 1),
        (1, "torn", 3.0, None, 4.0, 1), (2, "torn", 5.0, 2.0, 7.0, 1),
    ]
    df = spark.createDataFrame(rows, "ts_ms long, series_id string, avg double, min double, max double, count long")
    got = {r["series_id"]: tuple("nan" if x != x else x for x in (r["avg"], r["min"], r["max"], r["count"])) for r in buckets.rebucket(df, ["series_id"], 8, "sample_mean").collect()}
    assert got == {"known": (32.5, 1.0, 41.0, 20), "unknown": (25.0, 1.0, 41.0, None), "nan": ("nan", "nan", "nan", 9), "mixed": (6.0, 5.0, 9.0, 8), "torn": (4.0, None, 7.0, 2)}
