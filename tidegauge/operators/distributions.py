"""Bucketed distributions: rows (keys, ts_ms, bucket_lo, bucket_hi, count), buckets (lo, hi]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.ieee import wilson
from tidegauge.functions.timegrid import bucket_end


def from_samples(samples: DataFrame, keys: list[str], step: int, width: float) -> DataFrame:
    """Linear buckets (lo, lo + width] of samples, per END-time column."""
    hi = F.ceil(F.col("value") / width) * width
    return samples.groupBy(*keys, bucket_end(F.col("ts_ms"), step).alias("ts_ms"), (hi - width).alias("bucket_lo"), hi.cast("double").alias("bucket_hi")).agg(F.count("*").cast("double").alias("count"))


def rebucket_time(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    return rows.groupBy(*keys, bucket_end(F.col("ts_ms"), step).alias("ts_ms"), "bucket_lo", "bucket_hi").agg(F.sum("count").alias("count"))


def merge_edges(rows: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Merge adjacent buckets to multiples of width."""
    lo = F.floor(F.col("bucket_lo") / width) * width
    hi = F.ceil(F.col("bucket_hi") / width) * width
    return rows.groupBy(*keys, "ts_ms", lo.cast("double").alias("bucket_lo"), hi.cast("double").alias("bucket_hi")).agg(F.sum("count").alias("count"))


def window_histogram(rows: DataFrame, keys: list[str], start: int, end: int, step: int) -> DataFrame:
    """Sum of the whole columns (ts - step, ts] that overlap [start, end)."""
    return rows.filter((F.col("ts_ms") > start) & (F.col("ts_ms") - step < end)).groupBy(*keys, "bucket_lo", "bucket_hi").agg(F.sum("count").alias("count"))


def fraction_over(rows: DataFrame, keys: list[str], x: float) -> DataFrame:
    """Share of observations above x: exact where x is an edge, else between the shares without and with the bucket that
    holds x; with Wilson's interval of the lower share."""
    c = F.col("count")
    sums = rows.groupBy(*keys).agg(F.sum(c).alias("n"), F.sum(F.when(F.col("bucket_lo") >= x, c).otherwise(0.0)).alias("above"), F.sum(F.when((F.col("bucket_lo") < x) & (F.col("bucket_hi") > x), c).otherwise(0.0)).alias("holding"))
    low, high = wilson(F.col("above"), F.col("n"))
    return sums.select(*keys, "n", (F.col("above") / F.col("n")).alias("lo"), ((F.col("above") + F.col("holding")) / F.col("n")).alias("hi"), low.alias("wilson_lo"), high.alias("wilson_hi"))


def quantile_buckets(rows: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The source bucket that holds quantile q, never a value inside it; n is the column's count, at least 10 / (1 - q)."""
    order = Window.partitionBy(*keys).orderBy("bucket_hi", "bucket_lo")
    acc = rows.withColumn("acc", F.sum("count").over(order)).withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    hit = acc.filter((F.col("acc") >= F.col("n") * q * (1 - 1e-12)) & (F.col("n") >= 10 / (1 - q)))
    return hit.groupBy(*keys, "n").agg(F.min_by(F.struct("bucket_lo", "bucket_hi"), "acc").alias("b")).select(*keys, "n", "b.bucket_lo", "b.bucket_hi")


def cdf(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative share at each upper edge."""
    by_edge = rows.groupBy(*keys, "bucket_hi").agg(F.sum("count").alias("count"))
    return by_edge.withColumn("cdf", F.sum("count").over(Window.partitionBy(*keys).orderBy("bucket_hi")) / F.sum("count").over(Window.partitionBy(*keys)))


def ks_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest gap between two distributions' shares at the edges of either."""
    edges = a.select("bucket_hi").union(b.select("bucket_hi")).distinct()

    def at(rows: DataFrame, name: str) -> DataFrame:
        """Cumulative share of rows at all edges: counts are put on the edges and summed in order."""
        put = edges.join(rows.groupBy("bucket_hi").agg(F.sum("count").alias("c")), "bucket_hi", "left").select("bucket_hi", F.coalesce("c", F.lit(0.0)).alias("c"))
        whole = Window.orderBy("bucket_hi")
        return put.select("bucket_hi", (F.sum("c").over(whole) / F.sum("c").over(Window.partitionBy())).alias(name))

    return at(a, "fa").join(at(b, "fb"), "bucket_hi").agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("distance"))


def cumulative_to_buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts by upper edge (le, value) to counts per bucket, made monotone by a running maximum."""
    order = Window.partitionBy(*keys).orderBy("le")
    fixed = rows.withColumn("c", F.max("value").over(order))
    low: Column = F.coalesce(F.lag("le").over(order), F.lit(float("-inf")))
    return fixed.select(*keys, low.alias("bucket_lo"), F.col("le").alias("bucket_hi"), (F.col("c") - F.coalesce(F.lag("c").over(order), F.lit(0.0))).alias("count")).filter("count > 0")


def edge_of(text: Column) -> Column:
    """An upper edge written as a label: a number, or an infinity in any of its spellings; null for anything else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("+inf", "inf"), float("inf")).when(low == "-inf", float("-inf")).otherwise(text.try_cast("double"))


def range_of(text: Column) -> tuple[Column, Column]:
    """Both edges of a bucket written as lo...hi."""
    parts = F.split(text, r"\.\.\.")
    return edge_of(F.get(parts, 0)), edge_of(F.get(parts, 1))


def native_schema(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The coarsest exponential schema (edges at powers of 2 ^ (2 ^ -schema)) that all buckets with positive finite edges
    fit: the one of the widest, or null where one of them has another width or lies off its edges."""
    wide = F.log2(F.col("bucket_hi") / F.col("bucket_lo"))
    inside = rows.filter("bucket_lo > 0 AND bucket_hi < 'Infinity'::double").withColumn("s", F.round(-F.log2(wide)))
    inside = inside.withColumn("fits", (F.abs(wide * F.pow(F.lit(2.0), F.col("s")) - 1) < 1e-6) & (F.abs(F.log2("bucket_hi") * F.pow(F.lit(2.0), F.col("s")) - F.round(F.log2("bucket_hi") * F.pow(F.lit(2.0), F.col("s")))) < 1e-6))
    return inside.groupBy(*keys).agg(F.when(F.bool_and("fits"), F.min("s").cast("int")).alias("schema"))


def merge_values(rows: DataFrame, keys: list[str], scheme: str, max_rows: int) -> DataFrame:
    """Merge adjacent value buckets until a series has at most max_rows of them. classic and vmrange: every so many edges
    of the series' own list; native: 2 ^ k buckets of the schema. linear buckets are never merged."""
    if scheme not in ("classic", "vmrange", "native"):
        raise ValueError(f"{scheme} buckets are not merged by value")
    edges = rows.select(*keys, "bucket_lo", "bucket_hi").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("bucket_hi", "bucket_lo")) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    edges = edges.withColumn("place", place).withColumn("n", n)
    if scheme == "native":
        k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / max_rows)))
        by = F.pow(F.lit(2.0), k)
        wide = F.log2(F.col("bucket_hi") / F.col("bucket_lo"))
        edges = edges.withColumn("group", F.ceil(F.round(F.log2("bucket_hi") / wide) / by))
    else:
        edges = edges.withColumn("group", F.floor(F.col("place") / F.ceil(F.col("n") / max_rows)))
    merged = edges.groupBy(*keys, "group").agg(F.min("bucket_lo").alias("lo"), F.max("bucket_hi").alias("hi"))
    mapped = edges.join(merged, [*keys, "group"]).select(*keys, "bucket_lo", "bucket_hi", "lo", "hi")
    return rows.join(mapped, [*keys, "bucket_lo", "bucket_hi"]).groupBy(*keys, "ts_ms", F.col("lo").alias("bucket_lo"), F.col("hi").alias("bucket_hi")).agg(F.sum("count").alias("count"))


def column_quantiles(rows: DataFrame, keys: list[str], qs: tuple[float, ...]) -> DataFrame:
    """The bounds of several quantiles a column, as lo_<percent> and hi_<percent>; null where a column's count is below ten
    in the quantile's tail. One running sum serves all."""
    order = Window.partitionBy(*keys).orderBy("bucket_hi", "bucket_lo")
    acc = rows.withColumn("acc", F.sum("count").over(order)).withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    out = []
    for q in qs:
        reached = (F.col("acc") >= F.col("n") * q * (1 - 1e-12)) & (F.col("n") >= 10 / (1 - q))
        hit = F.min_by(F.struct("bucket_lo", "bucket_hi"), F.when(reached, F.col("acc")))
        out += [hit["bucket_lo"].alias(f"lo_{round(q * 100)}"), hit["bucket_hi"].alias(f"hi_{round(q * 100)}")]
    return acc.groupBy(*keys, "n").agg(*out)


def pooled(rows: DataFrame) -> DataFrame:
    """All series and columns summed by bucket."""
    return rows.groupBy("bucket_lo", "bucket_hi").agg(F.sum("count").alias("count"))


def common_edges(rows: DataFrame, of: list[str]) -> DataFrame:
    """Edges at which every one of several histograms splits exactly: no bucket of any holds them inside."""
    edges = rows.select(F.explode(F.array("bucket_lo", "bucket_hi")).alias("edge")).filter("edge > '-Infinity'::double AND edge < 'Infinity'::double").distinct()
    # A bucket that holds an edge inside is found among the few distinct buckets, not among all rows.
    held = rows.select("bucket_lo", "bucket_hi").distinct()
    return edges.join(held, (F.col("bucket_lo") < F.col("edge")) & (F.col("edge") < F.col("bucket_hi")), "left_anti")


def snap(edges: DataFrame, x: float) -> DataFrame:
    """The edge nearest to x by ratio; the smaller one of two as near."""
    return edges.filter("edge > 0").orderBy(F.abs(F.log(F.col("edge") / x)), "edge").limit(1)


def threshold(rows: DataFrame, share: float, least: float = 20.0) -> DataFrame:
    """The edge whose share of observations above comes nearest to the one asked for, of those with at least so many above."""
    by_edge = rows.groupBy("bucket_hi").agg(F.sum("count").alias("c"))
    # One row an edge, so windows over all of them are small.
    below = by_edge.withColumn("below", F.sum("c").over(Window.orderBy("bucket_hi"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    judged = below.withColumn("above", F.col("n") - F.col("below")).filter(F.col("above") >= least)
    return judged.withColumn("share", F.col("above") / F.col("n")).orderBy(F.abs(F.col("share") - share), "bucket_hi").limit(1).select(F.col("bucket_hi").alias("edge"), "share", "above")


def survival(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share above each upper edge."""
    return cdf(rows, keys).select(*keys, "bucket_hi", (1 - F.col("cdf")).alias("ccdf"))


def density(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a column in each bucket by its width; null for an open bucket."""
    n = F.sum("count").over(Window.partitionBy(*keys))
    wide = F.col("bucket_hi") - F.col("bucket_lo")
    return rows.withColumn("density", F.when(wide < float("inf"), F.try_divide(F.col("count"), n * wide)))


def qq(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """(q, a_lo, a_hi, b_lo, b_hi): the buckets of two distributions that hold the same quantiles."""

    def boxes(rows: DataFrame, name: str) -> DataFrame:
        flat = rows.groupBy("bucket_lo", "bucket_hi").agg(F.sum("count").alias("count"))
        order = Window.orderBy("bucket_hi", "bucket_lo")  # one row a bucket
        acc = flat.withColumn("high", F.sum("count").over(order)).withColumn("n", F.sum("count").over(Window.partitionBy()))
        acc = acc.withColumn("low", F.col("high") - F.col("count")).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))))
        at = F.col("n") * F.col("q") / levels * (1 - 1e-12)
        return acc.filter((F.col("low") < at) & (at <= F.col("high"))).select("q", F.col("bucket_lo").alias(f"{name}_lo"), F.col("bucket_hi").alias(f"{name}_hi"))

    return boxes(a, "a").join(boxes(b, "b"), "q").withColumn("q", F.col("q") / levels)


def sample_bins(rows: DataFrame, value: str, bins: int = 96) -> DataFrame:
    """Bins (lo, hi] of equal width, or of equal ratio where the greatest value is over 100 times the least positive one;
    the least value belongs to the first bin."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    a, b = ends["a"], ends["b"]
    if a is None:
        return rows.select(F.lit(0.0).alias("bucket_lo"), F.lit(0.0).alias("bucket_hi"), F.lit(0).cast("long").alias("count")).limit(0)
    logs = a > 0 and b / a > 100
    x = F.log(value) if logs else F.col(value)
    low, high = (F.log(F.lit(float(v))) if logs else F.lit(float(v)) for v in (a, b))
    wide = (high - low) / bins
    at = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.coalesce(F.try_divide(x - low, wide), F.lit(1.0)) - 1e-9))).cast("int")
    edge = lambda i: F.exp(low + wide * i) if logs else low + wide * i
    counted = rows.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    return counted.select(edge(F.col("bin") - 1).alias("bucket_lo"), edge(F.col("bin")).alias("bucket_hi"), "count")


# Words that tell how a request ended.
FAILED = ("error", "errors", "fail", "failed", "failure", "exception", "timeout", "timed_out", "unavailable", "internal", "deadline_exceeded", "aborted", "cancelled", "canceled", "false", "err", "5xx")
SUCCEEDED = ("ok", "success", "succeeded", "successful", "true", "2xx", "3xx", "none", "0")


def outcome(label: str, value: Column) -> Column:
    """success, failure or null: 2xx and 3xx against 5xx (4xx is the client's doing), or by word; the labels success and
    error are read as yes or no."""
    v = F.lower(F.trim(value))
    if label == "success":
        return F.when(v.isin("true", "1"), "success").when(v.isin("false", "0"), "failure")
    if label == "error":
        return F.when(v.isin("", "false", "0", "none"), "success").otherwise("failure")
    http = v.rlike("^[1-5][0-9][0-9]$")
    return F.when(http, F.when(v.startswith("5"), "failure").when(v.startswith("2") | v.startswith("3"), "success")).when(v.isin(*SUCCEEDED), "success").when(v.isin(*FAILED), "failure")
