import numpy as np
from pyspark.sql import functions as F

from tidegauge.kernels import control
from tidegauge.operators import buckets
from tidegauge.session import make_importable
from tidegauge.streaming import detectors, rollup

MINUTE = 60_000


def test_rollup_gives_the_batch_rollups_final_buckets(spark, tmp_path):
    rows = [("a", t, float(t % 7)) for t in range(1, 30 * MINUTE, 17_000)] + [("b", 5 * MINUTE, 2.0), ("b", 5 * MINUTE + 1, 3.0)]
    samples = spark.createDataFrame(rows, "k string, ts_ms long, value double")
    samples.filter(f"ts_ms <= {20 * MINUTE}").withColumn("ts", F.timestamp_millis("ts_ms")).write.parquet(str(tmp_path / "in"))
    samples.filter(f"ts_ms > {20 * MINUTE}").withColumn("ts", F.timestamp_millis("ts_ms")).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run starts at the checkpoint and adds nothing
        stream = spark.readStream.schema("k string, ts_ms long, value double, ts timestamp").parquet(str(tmp_path / "in"))
        rollup.write_final(rollup.rollup(stream, ["k"], 5 * MINUTE), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "ts_ms", "avg", "min", "max", "count").collect()}
    want = {tuple(r) for r in buckets.rollup(samples, ["k"], 5 * MINUTE).collect()}
    assert got and got <= want and ("b", 5 * MINUTE, 2.0, 2.0, 2.0, 1) in got
    last = max(t for _, t, _ in rows)
    assert {w for w in want if w[1] <= last - 5 * MINUTE} <= got


def test_cusum_keeps_its_state_between_batches(spark, tmp_path):
    make_importable(spark)
    y = np.random.default_rng(4).normal(size=60)
    y[30:] += 2
    rows = [("s", i * MINUTE, float(v)) for i, v in enumerate(y)]
    for at in range(0, 60, 20):
        spark.createDataFrame(rows[at : at + 20], "k string, ts_ms long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts_ms long, value double").parquet(str(tmp_path / "in"))
        query = detectors.cusum(stream, "k", 0.0, 1.0, MINUTE).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(r["ts_ms"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [i * MINUTE for i in control.cusum(y, np.zeros(60, dtype=int))] and got
