"""Spans of time: merged, looked up as of a time, met by ranges. No span is laid out step by step.

Times and spans are dealt to slots of the timeline, a span to each slot that it meets but to one slot of a coarser level
once it is long: a span of length n lies in at most two slots of the level whose slots are as long as it, and a time looks
into one slot of each level that holds spans. So a span of a year at a step of a second makes two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Milliseconds of the finest slot; each level's slots are FACTOR times as long as those below.
FINEST, FACTOR, LEVELS = 60_000, 16, 10
#: Rows of a part, alike in length and next to one another in time, that meet a span together.
SLOT_ROWS = 1_024


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) of disjoint spans [a, b): overlapping and touching ones joined; empty ones go."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    real = spans.filter("b > a").withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.sum(F.when(F.col("reach") >= F.col("a"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return real.withColumn("island", island).groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], time: str, since: str, columns: list[str]) -> DataFrame:
    """rows with columns of the last fact of their keys at or before their time (null if there is none); of facts of one
    time, the one with the greatest columns. One union and one window: a fact is carried to the rows behind it."""
    kind = facts.select(F.struct(*columns).alias("x")).schema["x"].dataType
    left = rows.withColumns({"__at": F.col(time), "__fact": F.lit(None).cast(kind), "__is_row": F.lit(True)})
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in keys]
    latest = facts.groupBy(*keys, since).agg(F.max(F.struct(*columns)).alias("__fact"))
    right = latest.select(*keys, *empty, F.col(since).alias("__at"), "__fact", F.lit(False).alias("__is_row"))
    order = Window.partitionBy(*keys).orderBy("__at", "__is_row").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__fact", F.last("__fact", ignorenulls=True).over(order))
    return both.filter("__is_row").select(*rows.columns, *[F.col("__fact")[c].alias(c) for c in columns])


def _level(length: Column) -> Column:
    """The finest level whose slots are at least as long as a span."""
    level = F.lit(LEVELS - 1)
    for n in range(LEVELS - 2, -1, -1):
        level = F.when(length <= FINEST * FACTOR**n, n).otherwise(level)
    return level


def _slot(time: Column, level: Column) -> Column:
    size = F.element_at(F.array(*[F.lit(FINEST * FACTOR**n).cast("long") for n in range(LEVELS)]), level + 1)
    return F.floor(time / size).cast("long")


def _meeting(rows: DataFrame, spans: DataFrame, keys: list[str], low: str, high: str, a: str, b: str) -> DataFrame:
    """rows joined with every span [a, b) of their keys that overlaps the row's range [low, high); each pair once. Both
    sides lie in at most two slots of their own level; rows of a finer level look up the coarser ones that hold spans, and
    the other way round, so that a range join is one equality join on (keys, level, slot)."""
    sides = []
    for df, x, y, tag in ((rows, low, high, "r"), (spans, a, b, "s")):
        own = _level(F.col(y) - F.col(x))
        sides.append(df.filter(F.col(y) > F.col(x)).withColumn(f"__{tag}", own))
    left, right = sides
    # Levels in use, at most LEVELS of each side: numbers, whatever the size of the tables.
    of_rows, of_spans = (sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((left, "__r"), (right, "__s")))

    def dealt(df: DataFrame, x: str, y: str, own: str, other: list[int]) -> DataFrame:
        # A pair meets at the coarser of its two levels.
        levels = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in other] or [F.lit(0)]), lambda n: F.greatest(n, F.col(own))))
        df = df.withColumn("__level", F.explode(levels))
        return df.withColumn("__slot", F.explode(F.sequence(_slot(F.col(x), F.col("__level")), _slot(F.col(y) - 1, F.col("__level")))))

    if not of_rows or not of_spans:
        return left.drop("__r").join(right.drop("__s"), keys).limit(0)
    joined = dealt(left, low, high, "__r", of_spans).join(dealt(right, a, b, "__s", of_rows), [*keys, "__level", "__slot"])
    overlap = (F.col(low) < F.col(b)) & (F.col(a) < F.col(high)) & (F.col("__level") == F.greatest("__r", "__s"))
    # Both may share two slots of a level: the pair counts in the one where it begins to overlap.
    begins = F.col("__slot") == _slot(F.greatest(F.col(low), F.col(a)), F.col("__level"))
    return joined.filter(overlap & begins).drop("__level", "__slot", "__r", "__s")


def containing(rows: DataFrame, spans: DataFrame, keys: list[str], low: str, high: str, a: str = "a", b: str = "b") -> DataFrame:
    """rows joined with every span [a, b) of their keys that overlaps the row's range [low, high); each pair once. Rows of
    like length that follow one another are a part of SLOT_ROWS; what meets on slots are spans and parts, and a span then goes
    to its parts. So a row is dealt once, a span about once for SLOT_ROWS pairs. Pairs come out span by span with the rows of
    a part always in one order, and mostly all of them: written to files, nearly every pair repeats what stands before it."""
    like = [*keys, "__like"]
    left = rows.filter(F.col(high) > F.col(low)).withColumn("__like", _level(F.col(high) - F.col(low)))
    # In full order, so that a part holds the same rows whenever it is made.
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    place = F.row_number().over(Window.partitionBy(*like).orderBy(low, high, *plain))
    left = left.withColumn("__part", F.floor((place - 1) / SLOT_ROWS))
    parts = left.groupBy(*like, "__part").agg(F.min(low).alias("__from"), F.max(high).alias("__to"))
    right = _meeting(parts, spans, keys, "__from", "__to", a, b).drop("__from", "__to")
    # With a number of their own, parts are not put together again for the few bytes that they hold before they meet.
    left = left.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *like, "__part")
    joined = right.hint("merge").join(left, [*like, "__part"]).filter((F.col(low) < F.col(b)) & (F.col(a) < F.col(high)))
    return joined.select(*keys, *[c for df in (rows, spans) for c in df.columns if c not in keys])


def overlaps_counted(rows: DataFrame, spans: DataFrame, ids: list[str], low: str, high: str, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(ids, keys, a, b, n): the pairs of containing(), counted by the row's ids and the span. Equal spans are one row with a
    count before they are joined, as are equal ranges of the same ids, so pairs are counted where they meet and none is
    shuffled: they may be quadratic, what is stored grows with the rows. Ids of unlike ranges alone are summed afterwards."""
    own = list(dict.fromkeys([*ids, *keys]))
    held = spans.filter(F.col(b) > F.col(a)).groupBy(*keys, a, b).agg(F.count("*").alias("__held"))
    ranges = rows.filter(F.col(high) > F.col(low)).groupBy(*own, low, high).agg(F.count("*").alias("__own"))
    ranges = ranges.withColumn("__several", F.count("*").over(Window.partitionBy(*own)) > 1)
    once = containing(ranges.filter(~F.col("__several")), held, keys, low, high, a, b)
    found = once.select(*own, a, b, (F.col("__own") * F.col("__held")).alias("n"))
    several = ranges.filter("__several")
    if several.isEmpty():
        return found
    more = containing(several, held, keys, low, high, a, b).groupBy(*own, a, b).agg(F.sum(F.col("__own") * F.col("__held")).alias("n"))
    return found.unionByName(more)


def in_spans(rows: DataFrame, spans: DataFrame, step: int, max_spans: int = 100_000) -> DataFrame:
    """rows with failed: does the bucket (ts_ms - step, ts_ms] meet one of the spans [a, b)? The spans hold for every series:
    they are the outages of a source, and more than max_spans are refused. Made disjoint, they go to each row as two sorted
    arrays, in which the last span that begins before the bucket's end is found by halving; rows stay where they are."""
    if spans.limit(max_spans + 1).count() > max_spans:
        raise ValueError(f"more than {max_spans} failed spans")
    apart = merged(spans.select(F.lit(0).alias("__all"), "a", "b"), ["__all"])
    lists = apart.groupBy("__all").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s")).select("__all", F.col("s.a").alias("__a"), F.col("s.b").alias("__b"))
    halves = F.array(*[F.lit(1 << n) for n in range(max_spans.bit_length() - 1, -1, -1)])
    fits = lambda at, half: (at + half <= F.size("__a")) & (F.get("__a", at + half - 1) < F.col("ts_ms"))
    begun = F.aggregate(halves, F.lit(0), lambda at, half: F.when(fits(at, half), at + half).otherwise(at))
    joined = rows.withColumn("__all", F.lit(0)).join(F.broadcast(lists), "__all", "left").withColumn("__at", begun)
    meets = F.coalesce((F.col("__at") > 0) & (F.get("__b", F.col("__at") - 1) > F.col("ts_ms") - step), F.lit(False))
    return joined.withColumn("failed", meets).select(*rows.columns, "failed")
