"""Instant-vector algebra: aggregation, ranking, matching and set operators on (t, labels..., value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.ieee import INF, NAN, quantile
from tidegauge.operators.ranges import greatest


def aggregate(vector: DataFrame, by: list[str], how: str, q: float = 0.5) -> DataFrame:
    v = F.col("value")
    value = {"sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": greatest(v), "count": F.count(v).cast("double"), "group": F.max(F.lit(1.0)), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v), "quantile": quantile(v, q)}[how]
    return vector.groupBy("t", *by).agg(value.alias("value"))


def ranked(vector: DataFrame, by: list[str], k: int, largest: bool, ties: list[str]) -> DataFrame:
    """topk or bottomk: k samples a group, NaN last, ties by labels."""
    v = F.col("value")
    order = Window.partitionBy("t", *by).orderBy(F.isnan(v), v.desc() if largest else v.asc(), *ties)
    return vector.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= k).drop("__place")


def match(left: DataFrame, right: DataFrame, on: list[str], value: Column, many_to_one: bool = False, include: list[str] | None = None) -> DataFrame:
    """Vector matching on (t, on): one to one, or many left rows to one right row. Where a match exists, a second row on
    a side that must be unique is an error; rows without a match may repeat. value combines the columns l and r; include
    names right labels to copy. One aggregation by key each side counts and carries its row, so no window is needed."""
    # The check names columns of both sides, or Spark would move it below the join, to rows that meet nothing.
    once = lambda ok: F.coalesce(F.assert_true(ok, F.lit("many-to-many matching")).isNull(), F.lit(True))
    never = F.isnan("l") & (F.col("l") == 0)
    rest = [c for c in left.columns if c not in ("t", "value", *on)]
    r = right.groupBy("t", *on).agg(F.first(F.struct(F.col("value").alias("r"), *(include or []))).alias("right"), F.count("*").alias("n_r"))
    if many_to_one:
        joined = left.withColumnRenamed("value", "l").join(r, ["t", *on]).filter(once((F.col("n_r") == 1) | never))
        out = joined.withColumn("r", F.col("right.r")).withColumn("value", value)
        return out.select(*[c for c in left.columns if c not in (include or [])], *[F.col(f"right.{c}").alias(c) for c in include or []])
    l = left.groupBy("t", *on).agg(F.first(F.struct(F.col("value").alias("l"), *rest)).alias("left"), F.count("*").alias("n_l"))  # noqa: E741
    joined = l.join(r, ["t", *on]).filter(once(F.col("n_l") + F.col("n_r") == 2))
    out = joined.select("t", *on, *[F.col(f"left.{c}").alias(c) for c in rest], F.col("left.l").alias("l"), F.col("right.r").alias("r"), *[F.col(f"right.{c}").alias(c) for c in include or []])
    return out.withColumn("value", value).drop("l", "r")


def set_and(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select("t", *on), ["t", *on], "left_semi")


def set_unless(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select("t", *on), ["t", *on], "left_anti")


def set_or(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.unionByName(set_unless(right, left, on))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Classic quantile of cumulative counts (le double, value): running maximum, first bucket at the rank, linear inside
    it. A rank in the last bucket gives the last finite edge; a first bucket at or below zero gives its edge. NaN where
    the last bucket is not +Inf, there is but one, or nothing was counted; -Inf and +Inf for q outside [0, 1]. A group's
    buckets are its edges, some dozens, so they are folded as one array."""
    rows = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"))
    if q != q or not 0 <= q <= 1:
        return rows.select(*keys, F.lit(NAN if q != q else -INF if q < 0 else INF).alias("value"))
    entry = F.struct(F.lit(0.0).alias("le"), F.lit(-INF).alias("c"))
    running = F.aggregate("b", F.array(entry).cast("array<struct<le:double,c:double>>"), lambda acc, x: F.concat(acc, F.array(F.struct(x["le"].alias("le"), F.greatest(F.element_at(acc, -1)["c"], x["value"]).alias("c")))))
    rows = rows.withColumn("b", F.slice(running, 2, F.size("b"))).withColumn("total", F.element_at("b", -1)["c"])
    rows = rows.withColumn("at", F.size(F.filter("b", lambda x: x["c"] < F.col("total") * q)))  # buckets below the rank
    here, below = F.get("b", F.col("at")), F.get("b", F.col("at") - 1)
    start, c0 = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["c"], F.lit(0.0))
    inside = start + (here["le"] - start) * F.try_divide(F.col("total") * q - c0, here["c"] - c0)
    void = (F.element_at("b", -1)["le"] != INF) | (F.size("b") < 2) | (F.col("total") == 0)
    value = F.when(void, NAN).when(F.col("at") == F.size("b") - 1, below["le"]).when((F.col("at") == 0) & (here["le"] <= 0), here["le"]).otherwise(F.coalesce(inside, start))
    return rows.select(*keys, value.alias("value"))
