"""Facts from text: exposition lines, CSV, and series that a caller hands over."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = "[a-zA-Z_:][a-zA-Z0-9_:]*"
_LINE = rf"^({_NAME})\s*(?:\{{(.*)\}})?\s*(\S+)(?:\s+(-?[0-9.eE+]+))?$"
_PAIR = r'\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def exposition(lines: DataFrame, default_ts_ms: int) -> DataFrame:
    """(labels, ts_ms, value) of exposition lines(value string): the name is the label __name__, escapes are undone, a line
    without a time has the default one. Of several values of a series at one time the last by text counts. A line that
    can't be read is an error that names it."""
    from tidegauge.query.evaluate import canonical

    rows = lines.select(F.trim("value").alias("line")).filter("line <> '' AND line NOT LIKE '#%'")
    part = lambda i: F.regexp_extract("line", _LINE, i)
    undone = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit(r"\\"), F.lit("\x00")), F.lit(r"\n"), F.lit("\n")), F.lit(r"\""), F.lit('"')), F.lit("\x00"), F.lit("\\"))
    pairs = F.regexp_extract_all(part(2), F.lit(_PAIR), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, _PAIR, 1).alias("key"), undone(F.regexp_extract(p, _PAIR, 2)).alias("value")))
    low = F.lower(part(3))
    number = F.when(low.isin("+inf", "inf"), math.inf).when(low == "-inf", -math.inf).otherwise(part(3).try_cast("double"))
    parsed = rows.select("line", part(1).alias("name"), entries.alias("entries"), number.alias("value"), F.coalesce(part(4).try_cast("double").cast("long"), F.lit(default_ts_ms)).alias("ts_ms"))
    bad = F.raise_error(F.concat(F.lit("cannot parse sample line: "), F.substring("line", 1, 120)))
    parsed = parsed.withColumn("value", F.when((F.col("name") == "") | F.col("value").isNull(), bad.cast("double")).otherwise(F.col("value")))
    labels = canonical(F.map_concat(F.create_map(F.lit("__name__"), F.col("name")), F.map_from_entries("entries")))
    return parsed.select(labels.alias("labels"), "ts_ms", "value").groupBy("labels", "ts_ms").agg(F.max("value").alias("value"))


def metadata(lines: DataFrame) -> DataFrame:
    """(name, type, help, unit) of # TYPE, # HELP and # UNIT lines."""
    pattern = rf"^#\s*(HELP|TYPE|UNIT)\s+({_NAME})\s+(.*)$"
    part = lambda i: F.regexp_extract(F.trim("value"), pattern, i)
    rows = lines.select(part(1).alias("kind"), part(2).alias("name"), part(3).alias("rest")).filter("name <> ''")
    of = lambda kind, default: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rest"))), F.lit(default)).alias(kind.lower())
    return rows.groupBy("name").agg(of("TYPE", "unknown"), of("HELP", ""), of("UNIT", ""))


def csv_table(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """A CSV file with a header as (ts_ms, column, value): the column ts, time or timestamp is epoch seconds, epoch
    milliseconds or an ISO time; every other one must be numeric. A file without a time column counts its rows as steps
    of a second up to now. Files are split by Spark, so rows need no order."""
    rows = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    time = next((c for c in rows.columns if c.lower() in ("ts", "ts_ms", "time", "timestamp")), None)
    values = [c for c in rows.columns if c != time]
    number = lambda c: F.when(F.trim(c) == "", None).otherwise(F.col(c).cast("double"))  # noqa: E731  ANSI: text that is no number is an error
    if time is None:
        at = F.lit(now_ms)
    else:
        epoch = F.col(time).try_cast("double")
        at = F.when(epoch.isNotNull(), F.when(F.abs(epoch) < 1e11, epoch * 1000).otherwise(epoch)).otherwise(F.unix_millis(F.col(time).cast("timestamp"))).cast("long")
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in values]))
    return rows.select(at.alias("ts_ms"), stacked.alias("x")).select("ts_ms", "x.*").filter("value IS NOT NULL")


def inline(spark: SparkSession, series: list[dict]) -> tuple[DataFrame, int]:
    """(label, ts_ms, value) of [{label, ts, values}] and their step, the greatest common divisor of all distances. Lists
    of different lengths, repeated times or labels are errors."""
    if len({s["label"] for s in series}) != len(series):
        raise ValueError("two series have the same label")
    for s in series:
        if len(s["ts"]) != len(s["values"]) or len(set(s["ts"])) != len(s["ts"]):
            raise ValueError(f"series {s['label']!r}: a value for each time, each time once")
    rows = [(s["label"], [int(t) for t in s["ts"]], [None if v is None else float(v) for v in s["values"]]) for s in series]
    times = sorted({t for _, ts, _ in rows for t in ts})
    step = functools.reduce(math.gcd, (b - a for a, b in zip(times, times[1:], strict=False)), 0)
    df = spark.createDataFrame(rows, "label string, ts array<bigint>, v array<double>")
    return df.select("label", F.explode(F.arrays_zip("ts", "v")).alias("x")).select("label", F.col("x.ts").alias("ts_ms"), F.col("x.v").alias("value")), step


def matrix(spark: SparkSession, columns: list[str], cells: list[list[float | None]]) -> DataFrame:
    """(row, column, value) of a table of numbers; rows of another length are an error."""
    if any(len(r) != len(columns) for r in cells):
        raise ValueError("each row has a cell for each column")
    df = spark.createDataFrame([(i, [None if v is None else float(v) for v in r]) for i, r in enumerate(cells)], "row int, cells array<double>")
    return df.select("row", F.posexplode("cells").alias("at", "value")).select("row", F.element_at(F.array(*map(F.lit, columns)), F.col("at") + 1).alias("column"), "value")
