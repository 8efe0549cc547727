"""A histogram metric as a distribution dataset: cumulative counters by upper edge, counters by range, or whole histograms a
sample become rows (keys, ts_ms, bucket_lo, bucket_hi, count) and columns (keys, ts_ms, n).

A column exists where the source answered: n = 0 says that nothing happened, no column that nobody looked. Everything is
one increase a series and one sum a bucket; edges are told from label sets, never from samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import ranges
from tidegauge.operators.distributions import edge_of, native_schema, range_of

INF = float("inf")


@dataclass
class Histogram:
    """rows: (keys, ts_ms, bucket_lo, bucket_hi, count); columns: (keys, ts_ms, n, repaired, estimated), with repaired where
    cumulative counts fell from one edge to the next and estimated where a count is no whole number; form: classic, native or
    vmrange, none where nothing was found."""

    rows: DataFrame
    columns: DataFrame
    form: str
    keys: list[str]

    def scheme(self) -> DataFrame:
        """One row (form, schema, edges): a native schema where all buckets fit one, else the finite edges that every
        series has."""
        finite = F.when((F.col("edge") > -INF) & (F.col("edge") < INF), F.col("edge"))
        if self.form == "native":
            schema = native_schema(self.rows.withColumn("__all", F.lit(0)), ["__all"]).select("schema")
            return schema.select(F.lit(self.form).alias("form"), "schema", F.array().cast("array<double>").alias("edges"))
        series = self.rows.select(*self.keys).distinct().agg(F.count("*").alias("n_series")) if self.keys else self.rows.limit(1).agg(F.count("*").alias("n_series"))
        edges = self.rows.select(*self.keys, F.explode(F.array("bucket_lo", "bucket_hi")).alias("edge")).distinct().groupBy(finite.alias("edge")).agg(F.count("*").alias("held")).filter("edge IS NOT NULL")
        common = edges.withColumn("__k", F.lit(0)).join(series.withColumn("__k", F.lit(0)), "__k").filter("held = n_series")
        return common.agg(F.sort_array(F.collect_set("edge")).alias("edges")).select(F.lit(self.form).alias("form"), F.lit(None).cast("int").alias("schema"), "edges")


def _form(sets: DataFrame) -> str:
    """The form of a selection from its distinct (le, vmrange): one row comes to the driver."""
    r = sets.agg(F.count("le").alias("classic"), F.count("vmrange").alias("vmrange"), F.count_if(F.col("le").isNull() & F.col("vmrange").isNull()).alias("plain")).first()
    if r["plain"]:
        raise ValueError("not a histogram: a series has neither an le nor a vmrange label")
    if r["classic"] and r["vmrange"]:
        raise ValueError("the selection holds several forms of histogram: classic, vmrange")
    return "classic" if r["classic"] else "vmrange" if r["vmrange"] else "none"


def increases(points: DataFrame, by: list[str], step: int) -> DataFrame:
    """(by, le, vmrange, ts_ms, value): what each bucket's counter rose by within each step, summed over the series of a
    group. points: (labels as JSON text, ts_ms, value). Series of one group must have the same edges, since a sum over
    unlike layouts is no cumulative count; the label sets alone tell, once for all times."""
    sets = points.select("labels").distinct().withColumn("m", F.from_json("labels", "map<string,string>"))
    own = F.to_json(F.map_filter("m", lambda k, _: ~k.isin("le", "__name__")))
    group = [F.coalesce(F.col("m")[b], F.lit("")).alias(b) for b in by]
    sets = sets.select("labels", *group, F.col("m")["le"].alias("le"), F.col("m")["vmrange"].alias("vmrange"), own.alias("series"))
    _form(sets)
    layouts = sets.filter("le IS NOT NULL").groupBy(*by, "series").agg(F.sort_array(F.collect_set("le")).alias("edges")).groupBy(*by).agg(F.count_distinct("edges").alias("layouts"))
    if not layouts.filter("layouts > 1").isEmpty():
        raise ValueError("series of one group have different bucket edges: group by the label that tells them apart")
    risen = ranges.extrapolated(points.select("labels", "ts_ms", "value"), ["labels"], step, step, counter=True, per_second=False)
    met = risen.join(sets.drop("series"), "labels")
    return met.groupBy(*by, "le", "vmrange", F.col("t").alias("ts_ms")).agg(F.sum("value").alias("value"))


def from_matrix(matrix: DataFrame, keys: list[str]) -> Histogram:
    """A matrix (keys, le, vmrange, ts_ms, value) of bucket counts a step. Cumulative counts are made to rise by a running
    maximum; a column whose greatest edge is not infinite, or whose counts are no numbers, is left out as unanswered."""
    form = _form(matrix.select("le", "vmrange").distinct())
    known = ~F.isnan("value") & (F.abs("value") < INF)
    fraction = lambda c: F.abs(c - F.round(c)) > 1e-6
    if form == "vmrange":
        lo, hi = range_of(F.col("vmrange"))
        rows = matrix.filter(known).select(*keys, "ts_ms", lo.alias("bucket_lo"), hi.alias("bucket_hi"), F.col("value").alias("count"))
        columns = rows.groupBy(*keys, "ts_ms").agg(F.sum("count").alias("n"), F.lit(False).alias("repaired"), F.bool_or(fraction(F.col("count"))).alias("estimated"))
        return Histogram(rows.filter("count > 0"), columns, form, keys)
    order = Window.partitionBy(*keys, "ts_ms").orderBy("edge")
    cells = matrix.withColumn("edge", edge_of(F.col("le"))).withColumn("v", F.when(known, F.col("value")))
    cells = cells.groupBy(*keys, "ts_ms", "edge").agg(F.sum("v").alias("v"), F.count_if(F.col("v").isNull()).alias("gone"))
    whole = Window.partitionBy(*keys, "ts_ms")
    cells = cells.withColumn("c", F.max("v").over(order)).withColumn("void", (F.sum("gone").over(whole) > 0) | (F.max("edge").over(whole) < INF)).filter("NOT void")
    cells = cells.withColumn("bucket_lo", F.coalesce(F.lag("edge").over(order), F.lit(-INF))).withColumn("count", F.col("c") - F.coalesce(F.lag("c").over(order), F.lit(0.0)))
    columns = cells.groupBy(*keys, "ts_ms").agg(F.max("c").alias("n"), F.bool_or(F.col("c") - F.col("v") > 1e-9 * F.greatest(F.lit(1.0), F.col("c"))).alias("repaired"), F.bool_or(fraction(F.col("count"))).alias("estimated"))
    return Histogram(cells.filter("count > 0").select(*keys, "ts_ms", "bucket_lo", F.col("edge").alias("bucket_hi"), "count"), columns, form, keys)


def from_native(samples: DataFrame, keys: list[str]) -> Histogram:
    """samples: (keys, ts_ms, buckets array<struct<lo, hi, count>>), one whole histogram each; of one time, the sum."""
    cells = samples.select(*keys, "ts_ms", F.explode_outer("buckets").alias("b"))
    n = F.coalesce(F.sum("b.count"), F.lit(0.0))
    part = lambda c: F.abs(c - F.round(c)) > 1e-6
    columns = cells.groupBy(*keys, "ts_ms").agg(n.alias("n"), F.lit(False).alias("repaired"), F.coalesce(F.bool_or(part(F.col("b.count"))), F.lit(False)).alias("estimated"))
    rows = cells.filter("b.count > 0").groupBy(*keys, "ts_ms", F.col("b.lo").alias("bucket_lo"), F.col("b.hi").alias("bucket_hi")).agg(F.sum("b.count").alias("count"))
    return Histogram(rows, columns, "native", keys)


def fetch(points: DataFrame, by: list[str], step: int) -> Histogram:
    """The distribution of a histogram metric a step, by labels; from counters an edge or a range."""
    return from_matrix(increases(points, by, step), by)


def answered(histogram: Histogram, grid: DataFrame) -> DataFrame:
    """(keys, ts_ms, n) on a grid (keys, ts_ms): null where there is no column, 0 where it is empty."""
    return grid.join(histogram.columns.select(*histogram.keys, "ts_ms", "n"), [*histogram.keys, "ts_ms"], "left")


def mean_of(histogram: Histogram, lowest: Column | None = None) -> DataFrame:
    """(keys, ts_ms, lo, hi): bounds of the mean from the buckets' edges; null where an open bucket leaves one open. lowest:
    a bound of the values themselves, where one is known."""
    lo = F.when(F.col("bucket_lo") > -INF, F.col("bucket_lo"))
    lo = F.coalesce(lo, lowest) if lowest is not None else lo
    hi = F.when(F.col("bucket_hi") < INF, F.col("bucket_hi"))
    bound = lambda e: F.when(F.count_if(e.isNull()) == 0, F.sum(e * F.col("count")) / F.sum("count"))
    return histogram.rows.groupBy(*histogram.keys, "ts_ms").agg(bound(lo).alias("lo"), bound(hi).alias("hi"))
