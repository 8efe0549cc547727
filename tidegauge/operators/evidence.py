"""How much of a claim's window its evidence covers: evidence windows are joined first, so what two of them share counts once,
then claims meet them by range. Keys are what a claim and its evidence must agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.spans import containing, merged


def _met(claims: DataFrame, evidence: DataFrame, keys: list[str], claim: str) -> DataFrame:
    """(keys, claim, low, high, a, b): claims with the parts of joined evidence inside their window [low, high)."""
    found = containing(claims.select(*keys, claim, "low", "high"), merged(evidence, keys), keys, "low", "high")
    return found.withColumn("a", F.greatest("a", "low")).withColumn("b", F.least("b", "high"))


def cover(claims: DataFrame, evidence: DataFrame, keys: list[str], claim: str) -> DataFrame:
    """(keys, claim, low, high, covered, share, verdict): milliseconds of each claim's window that evidence covers; whole,
    partly or bare. claims: (keys, claim, low, high), each claim once; evidence: (keys, a, b)."""
    parts = _met(claims, evidence, keys, claim).groupBy(*keys, claim).agg(F.sum(F.col("b") - F.col("a")).alias("covered"))
    rows = claims.select(*keys, claim, "low", "high").join(parts, [*keys, claim], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    share = F.try_divide(F.col("covered"), F.col("high") - F.col("low"))
    verdict = F.when(F.col("covered") == F.col("high") - F.col("low"), "whole").when(F.col("covered") > 0, "partly").otherwise("bare")
    return rows.withColumn("share", share).withColumn("verdict", verdict)


def bare(claims: DataFrame, evidence: DataFrame, keys: list[str], claim: str) -> DataFrame:
    """(keys, claim, a, b): the spans of each claim's window that no evidence covers: between the covered parts, which are
    apart and in order, and before the first and behind the last."""
    parts = _met(claims, evidence, keys, claim).select(*keys, claim, "low", "high", "a", "b")
    ends = claims.select(*keys, claim, "low", "high", F.col("high").alias("a"), F.col("high").alias("b"))
    order = Window.partitionBy(*keys, claim).orderBy("a", "b")
    rows = parts.unionByName(ends).withColumn("from", F.coalesce(F.lag("b").over(order), F.col("low")))
    return rows.filter("a > from").select(*keys, claim, F.col("from").alias("a"), F.col("a").alias("b"))
