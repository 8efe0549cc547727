"""Expressions as DataFrame plans: all grid times in one pass, with time as a column.

A vector is (t, labels, value), at most one row for each t and labels; labels is the label set as JSON text with sorted
names, so that it groups and joins like any column. A scalar is a column over t. Points come as (labels, ts_ms, value).
Label sets are matched on the distinct sets alone, and the points of those that match are then found by a semi join.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import ieee
from tidegauge.operators import ranges, vectors
from tidegauge.query import parser as ast

LOOKBACK = 300_000
#: Limits refuse; they never cut.
MAX_STEPS = 11_000
#: Label sets that may be broadcast to the points.
MAX_BROADCAST_SERIES = 100_000
_MAP = "map<string,string>"


class Unsupported(ValueError):
    """The language knows it, this evaluator does not."""


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    def times(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.start, self.end + 1, self.step).withColumnRenamed("id", "t")


@dataclass
class Vector:
    rows: DataFrame
    unique: bool = True  # False: labels were dropped, so two series may have become one


@dataclass
class Scalar:
    value: Column
    rows: DataFrame | None = None  # (t, value) where the value depends on data


def canonical(labels: Column) -> Column:
    """A label map as text: sorted by name, empty labels left out."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(labels, lambda k, v: v.isNotNull() & (v != ""))))))


def _labels() -> Column:
    return F.from_json("labels", _MAP)


def _keep(names: tuple[str, ...]) -> Column:
    return canonical(F.map_filter(_labels(), lambda k, v: k.isin(*names) if names else F.lit(False)))


def _drop(*names: str) -> Column:
    return canonical(F.map_filter(_labels(), lambda k, v: ~k.isin(*names)))


def matches(m: ast.Matcher) -> Column:
    """A missing label is the empty text; a pattern must meet the whole of it."""
    got = F.coalesce(F.try_element_at(_labels(), F.lit(m.name)), F.lit(""))
    if m.op in ("=", "!="):
        return got == m.value if m.op == "=" else got != m.value
    hit = got.rlike(f"^(?s:{m.value})$")
    return hit if m.op == "=~" else ~hit


def points(samples: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Points of a table (labels..., ts_ms, value): one series for each set of label values."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    return samples.select(canonical(F.create_map(F.lit("__name__"), F.lit(name), *pairs)).alias("labels"), "ts_ms", "value")


_MATH = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "exp": F.exp, "ln": ieee.ln, "log2": lambda x: ieee.log_of(x, 2.0), "log10": lambda x: ieee.log_of(x, 10.0),
    "sqrt": ieee.sqrt, "sgn": lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x)), "deg": F.degrees, "rad": F.radians,
}
_MATH["ceil"] = lambda x: F.when(ieee.finite(x).isNull(), x).otherwise(F.ceil(ieee.finite(x)).cast("double"))
_MATH["floor"] = lambda x: F.when(ieee.finite(x).isNull(), x).otherwise(F.floor(ieee.finite(x)).cast("double"))
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee.div, "%": ieee.mod, "^": ieee.power, "atan2": F.atan2}
_COMPARE = {
    "==": ieee.same, "!=": lambda a, b: ~ieee.same(a, b), ">": lambda a, b: (a > b) & ~F.isnan(a) & ~F.isnan(b), "<": lambda a, b: (a < b) & ~F.isnan(a) & ~F.isnan(b),
    ">=": lambda a, b: (a >= b) & ~F.isnan(a) & ~F.isnan(b), "<=": lambda a, b: (a <= b) & ~F.isnan(a) & ~F.isnan(b),
}
_RATES = {"rate": (True, True), "increase": (True, False), "delta": (False, False)}


class Evaluator:
    def __init__(self, samples: DataFrame | dict[str, DataFrame], lookback: int = LOOKBACK) -> None:
        """samples: points of all metrics, or by metric name, of which an expression reads those that it names."""
        self.by_name = samples if isinstance(samples, dict) else {}
        self.points = functools.reduce(DataFrame.unionByName, samples.values()) if self.by_name else samples
        self.lookback, self.spark = lookback, self.points.sparkSession

    def range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """(t, labels, value) of an expression at start, start + step, ... up to end; a label set that two series of one
        time share is an error, as is a grid of more than MAX_STEPS times."""
        if step <= 0 or end < start or (end - start) // step >= MAX_STEPS:
            raise ValueError(f"1 to {MAX_STEPS} steps are allowed from start to end")
        grid = Grid(start, start + (end - start) // step * step, step)
        found = self._eval(ast.parse(text), grid)
        if isinstance(found, Scalar):
            return self._over(grid, found).withColumn("labels", F.lit("{}")).select("t", "labels", "value")
        if not isinstance(found, Vector):
            raise ValueError("the expression is neither a vector nor a scalar")
        rows = found.rows.select("t", "labels", F.col("value").cast("double").alias("value"))
        if found.unique:
            return rows
        one = rows.groupBy("t", "labels").agg(F.first("value").alias("value"), F.count("*").alias("n"))
        ok = F.assert_true(F.col("n") == 1, F.lit("two series of one time have the same labels"))
        return one.filter(F.coalesce(ok.isNull(), F.lit(True))).drop("n")

    def instant(self, text: str, at: int) -> DataFrame:
        """(labels, value) at one time; sort() and sort_desc() order it."""
        rows = self.range(text, at, at, max(1, self.lookback))
        node = ast.parse(text)
        if isinstance(node, ast.Call) and node.name in ("sort", "sort_desc"):
            v = F.col("value")
            rows = rows.orderBy(F.isnan(v), v.desc() if node.name == "sort_desc" else v.asc(), "labels")
        return rows.select("labels", "value")

    def series(self, matchers: tuple[ast.Matcher, ...], start: int | None = None, end: int | None = None) -> DataFrame:
        """Label sets that meet the matchers and have a point within start..end."""
        rows = self.points
        if start is not None:
            rows = rows.filter(F.col("ts_ms") >= start)
        if end is not None:
            rows = rows.filter(F.col("ts_ms") <= end)
        return rows.select("labels").distinct().filter(functools.reduce(lambda a, b: a & b, map(matches, matchers)))

    def label_values(self, label: str, matchers: tuple[ast.Matcher, ...], limit: int, start: int | None = None, end: int | None = None) -> DataFrame:
        value = F.try_element_at(_labels(), F.lit(label))
        return self.series(matchers, start, end).select(value.alias("value")).filter("value IS NOT NULL").distinct().orderBy("value").limit(limit)

    # --- selection ---
    def _of_metric(self, matchers: tuple[ast.Matcher, ...]) -> tuple[DataFrame, list[ast.Matcher]]:
        """Points of the metric that the matchers name, where points are held by name, and the matchers left to be met."""
        names = {m.value for m in matchers if m.name == "__name__" and m.op == "="}
        if len(names) != 1 or not (names & self.by_name.keys()):
            return self.points, list(matchers)
        return self.by_name[names.pop()], [m for m in matchers if not (m.name == "__name__" and m.op == "=")]

    def _select(self, node: ast.Selector, low: int, high: int) -> DataFrame:
        """Points with low < ts_ms <= high of the series that match."""
        points, matchers = self._of_metric(node.matchers)
        near = points.filter((F.col("ts_ms") > low) & (F.col("ts_ms") <= high))
        if not matchers:
            return near
        sets = near.select("labels").distinct().filter(functools.reduce(lambda a, b: a & b, map(matches, matchers)))
        # A condition on the text would be evaluated for each point; on the distinct sets, once a series. Spark sizes the join.
        return near.join(sets, "labels", "left_semi")

    def _window_samples(self, node: ast.Selector | ast.Matrix, grid: Grid, width: int) -> tuple[DataFrame, Grid]:
        """Samples in the grid's own time, which begins at 0: what a window of a time t sees lies in (t - width, t]."""
        at = {"start": grid.start, "end": grid.end}.get(node.at, node.at)
        own = grid if at is None else Grid(at, at, grid.step)
        low, high = own.start - node.offset - width, own.end - node.offset
        if isinstance(node, ast.Matrix) and node.resolution is not None:
            step = node.resolution or grid.step
            inner = Grid((low // step + 1) * step, high // step * step, step)
            found = self._eval(node.of, inner)
            rows = (self._over(inner, found).withColumn("labels", F.lit("{}")) if isinstance(found, Scalar) else found.rows).withColumnRenamed("t", "ts_ms")
        else:
            rows = self._select(node.of if isinstance(node, ast.Matrix) else node, low, high)
        return rows.select("labels", (F.col("ts_ms") + (node.offset - own.start)).alias("ts_ms"), "value"), own

    def _apply(self, node: ast.Selector | ast.Matrix, grid: Grid, width: int, function) -> DataFrame:  # noqa: ANN001
        """function(samples, step) in the grid's own time, at the grid's times; a fixed time's result holds for all."""
        if isinstance(node, ast.Matrix) and node.resolution is None:
            inner = node.of
            node = ast.Matrix(inner, node.width, None, node.offset + inner.offset, node.at if node.at is not None else inner.at)
        samples, own = self._window_samples(node, grid, width)
        step = own.step if own.end > own.start else width
        rows = function(samples, step).filter((F.col("t") >= 0) & (F.col("t") <= own.end - own.start) & (F.col("t") % step == 0))
        if own is grid or own == grid:
            return rows.withColumn("t", F.col("t") + own.start)
        times = F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step)).cast("array<bigint>")
        return rows.withColumn("t", F.explode(times))

    # --- evaluation ---
    def _over(self, grid: Grid, s: Scalar) -> DataFrame:
        times = grid.times(self.spark)
        if s.rows is None:
            return times.withColumn("value", s.value.cast("double"))
        return times.join(s.rows, "t", "left").withColumn("value", F.coalesce("value", F.lit(ieee.NAN)))

    def _eval(self, node: object, grid: Grid) -> Vector | Scalar | str:
        match node:
            case ast.Number(value):
                return Scalar(F.lit(value))
            case ast.Text(value):
                return value
            case ast.Selector():
                last = lambda x, step: ranges.folded(x, ["labels"], step, self.lookback, "last")
                return Vector(self._apply(node, grid, self.lookback, last))
            case ast.Matrix():
                raise ValueError("a range needs a function over it")
            case ast.Negative(of):
                found = self._eval(of, grid)
                if isinstance(found, Scalar):
                    return self._scalar(found, lambda x: -x)
                return self._nameless(found, -F.col("value"))
            case ast.Aggregate():
                return self._aggregate(node, grid)
            case ast.Binary():
                return self._binary(node, grid)
            case ast.Call():
                return self._call(node, grid)
        raise Unsupported(type(node).__name__)

    @staticmethod
    def _scalar(s: Scalar, f) -> Scalar:  # noqa: ANN001
        return Scalar(f(s.value)) if s.rows is None else Scalar(s.value, s.rows.withColumn("value", f(F.col("value"))))

    @staticmethod
    def _nameless(v: Vector, value: Column) -> Vector:
        return Vector(v.rows.select("t", _drop("__name__").alias("labels"), value.alias("value")), False)

    def _vector(self, node: object, grid: Grid) -> Vector:
        found = self._eval(node, grid)
        if not isinstance(found, Vector):
            raise ValueError("a vector is wanted")
        return found

    def _constant(self, node: object) -> float:
        match node:
            case ast.Number(value):
                return value
            case ast.Negative(of):
                return -self._constant(of)
        raise Unsupported("a parameter must be a number")

    def _with_scalar(self, v: DataFrame, s: Scalar) -> tuple[DataFrame, Column]:
        """v with the scalar of each time beside it. The other side is the grid, at most MAX_STEPS rows."""
        if s.rows is None:
            return v, s.value
        return v.join(F.broadcast(s.rows.withColumnRenamed("value", "__s")), "t", "left"), F.coalesce("__s", F.lit(ieee.NAN))

    def _call(self, node: ast.Call, grid: Grid) -> Vector | Scalar:
        name, args, v = node.name, node.args, F.col("value")
        if name == "time":
            return Scalar(F.col("t") / 1000)
        if name == "vector":
            found = self._eval(args[0], grid)
            return Vector(self._over(grid, found).select("t", F.lit("{}").alias("labels"), "value"))
        if name == "scalar":
            rows = self._vector(args[0], grid).rows.groupBy("t").agg(F.when(F.count("*") == 1, F.first("value")).otherwise(ieee.NAN).alias("value"))
            return Scalar(v, rows)
        if name in _MATH:
            found = self._eval(args[0], grid)
            return self._scalar(found, _MATH[name]) if isinstance(found, Scalar) else self._nameless(found, _MATH[name](v))
        if name in ("clamp", "clamp_min", "clamp_max"):
            found = self._vector(args[0], grid)
            low = self._constant(args[1]) if name != "clamp_max" else -ieee.INF
            high = self._constant(args[-1]) if name != "clamp_min" else ieee.INF
            return self._nameless(Vector(found.rows.filter(F.lit(low <= high))), ieee.clamp(v, low, high))
        if name == "round":
            return self._nameless(self._vector(args[0], grid), ieee.round_to(v, self._constant(args[1]) if len(args) > 1 else 1.0))
        if name == "timestamp":
            if isinstance(args[0], ast.Selector):
                last = lambda x, step: ranges.folded(x.withColumn("value", (F.col("ts_ms") + (grid.start - args[0].offset)) / 1000), ["labels"], step, self.lookback, "last")
                return self._nameless(Vector(self._apply(args[0], grid, self.lookback, last)), v)
            return self._nameless(self._vector(args[0], grid), F.col("t") / 1000)
        if name in ("sort", "sort_desc"):
            return self._vector(args[0], grid)  # instant() orders
        if name == "absent":
            rows = self._vector(args[0], grid).rows.select("t").distinct()
            known = {}
            if isinstance(args[0], ast.Selector):
                equal = [m for m in args[0].matchers if m.op == "=" and m.name != "__name__"]
                known = {m.name: m.value for m in equal if sum(x.name == m.name for x in args[0].matchers) == 1}
            labels = canonical(F.create_map(*[F.lit(x) for k in known for x in (k, known[k])])) if known else F.lit("{}")
            return Vector(grid.times(self.spark).join(rows, "t", "left_anti").select("t", labels.alias("labels"), F.lit(1.0).alias("value")))
        if name == "label_replace":
            return self._label_replace(node, grid)
        if name == "label_join":
            found, (target, separator, *sources) = self._vector(args[0], grid), [a.value for a in args[1:]]
            joined = F.concat_ws(separator, *[F.coalesce(F.try_element_at(_labels(), F.lit(x)), F.lit("")) for x in sources])
            return Vector(found.rows.select("t", self._set(target, joined).alias("labels"), "value"), False)
        if name == "histogram_quantile":
            return self._histogram_quantile(node, grid)
        return self._range_function(node, grid)

    @staticmethod
    def _set(label: str, value: Column) -> Column:
        return canonical(F.map_concat(F.map_filter(_labels(), lambda k, v: k != label), F.create_map(F.lit(label), value)))

    def _label_replace(self, node: ast.Call, grid: Grid) -> Vector:
        """The whole source must meet the pattern; $1 and ${name} stand for its groups; an empty result deletes the label."""
        found, (target, replacement, source, pattern) = self._vector(node.args[0], grid), [a.value for a in node.args[1:]]
        got = F.coalesce(F.try_element_at(_labels(), F.lit(source)), F.lit(""))
        whole = f"^(?s:{pattern})$"
        new = self._set(target, F.regexp_replace(got, whole, replacement))
        return Vector(found.rows.select("t", F.when(got.rlike(whole), new).otherwise(F.col("labels")).alias("labels"), "value"), False)

    def _histogram_quantile(self, node: ast.Call, grid: Grid) -> Vector:
        found = self._vector(node.args[1], grid)
        le = F.try_element_at(_labels(), F.lit("le"))
        edge = F.when(F.lower(le).isin("+inf", "inf"), ieee.INF).otherwise(le.try_cast("double"))
        rows = found.rows.select("t", _drop("__name__", "le").alias("labels"), edge.alias("le"), "value").filter("le IS NOT NULL")
        return Vector(vectors.histogram_quantile(rows, ["t", "labels"], self._constant(node.args[0])))

    def _range_function(self, node: ast.Call, grid: Grid) -> Vector:
        matrix = next((a for a in node.args if isinstance(a, ast.Matrix)), None)
        name, how, v = node.name, node.name.removesuffix("_over_time"), F.col("value")
        if matrix is None:
            raise Unsupported(f"{name}()")
        width, keys = matrix.width, ["labels"]
        seconds = (F.col("ts_ms") - F.col("t")) / 1000
        raw = lambda f, few=1: lambda x, step: ranges.over_time(x, keys, step, width, value=f, n=F.count("*")).filter(F.col("n") >= few).drop("n")
        if name.endswith("_over_time") and how in ranges.TILED:
            run = lambda x, step: ranges.folded(x, keys, step, width, how)
        elif name == "quantile_over_time":
            run = raw(ieee.quantile(v, self._constant(node.args[0])))
        elif name in _RATES:
            run = lambda x, step: ranges.extrapolated(x, keys, step, width, *_RATES[name])
        elif name in ("irate", "idelta"):
            run = lambda x, step: ranges.instant(x, keys, step, width, name == "irate")
        elif name in ("changes", "resets"):
            run = lambda x, step: ranges.pairwise(x, keys, step, width, name == "resets").withColumn("value", v.cast("double"))
        elif name == "deriv":
            run = raw(F.regr_slope(v, seconds), 2)
        elif name == "predict_linear":
            run = raw(F.regr_intercept(v, seconds) + self._constant(node.args[1]) * F.regr_slope(v, seconds), 2)
        else:
            raise Unsupported(f"{name}()")
        found = Vector(self._apply(matrix, grid, width, run))
        return found if how in ("last", "first") else self._nameless(found, v)

    def _aggregate(self, node: ast.Aggregate, grid: Grid) -> Vector:
        *parameters, of = node.args
        found = self._vector(of, grid)
        group = _drop("__name__", *node.labels) if node.without else _keep(node.labels)
        if node.op in ("topk", "bottomk"):
            rows = found.rows.withColumn("group", group)
            return Vector(vectors.ranked(rows, ["group"], int(self._constant(parameters[0])), node.op == "topk", ["labels"]).drop("group"), found.unique)
        if node.op == "count_values":
            text = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
            counted = found.rows.withColumn("labels", group).withColumn("labels", self._set(parameters[0].value, text))
            return Vector(counted.groupBy("t", "labels").agg(F.count("*").cast("double").alias("value")))
        q = self._constant(parameters[0]) if parameters else 0.5
        return Vector(vectors.aggregate(found.rows.withColumn("labels", group), ["labels"], node.op, q))

    # --- binary operators ---
    def _binary(self, node: ast.Binary, grid: Grid) -> Vector | Scalar:
        left, right = self._eval(node.left, grid), self._eval(node.right, grid)
        compare = node.op in ast.COMPARISONS
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if compare and not node.as_bool:
                raise ValueError("scalars are compared with bool")
            f = (lambda a, b: _COMPARE[node.op](a, b).cast("double")) if compare else _ARITHMETIC[node.op]
            if left.rows is None and right.rows is None:
                return Scalar(f(left.value, right.value))
            both = self._over(grid, left).withColumnRenamed("value", "a").join(self._over(grid, right).withColumnRenamed("value", "b"), "t")
            return Scalar(F.col("value"), both.select("t", f(F.col("a"), F.col("b")).alias("value")))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            return self._vector_scalar(node, left, right)
        if node.op in ast.SETS:
            return self._set_operator(node, left, right)
        return self._vector_vector(node, left, right)

    def _vector_scalar(self, node: ast.Binary, left: Vector | Scalar, right: Vector | Scalar) -> Vector:
        if node.op in ast.SETS:
            raise ValueError(f"{node.op} goes between vectors")
        v, s = (left, right) if isinstance(left, Vector) else (right, left)
        rows, other = self._with_scalar(v.rows, s)
        a, b = (F.col("value"), other) if isinstance(left, Vector) else (other, F.col("value"))
        if node.op in ast.COMPARISONS and not node.as_bool:
            return Vector(rows.filter(_COMPARE[node.op](a, b)).select("t", "labels", "value"), v.unique)
        value = _COMPARE[node.op](a, b).cast("double") if node.as_bool else _ARITHMETIC[node.op](a, b)
        return self._nameless(Vector(rows), value)

    @staticmethod
    def _signature(m: ast.Matching) -> Column:
        return _keep(m.labels) if m.on else _drop("__name__", *m.labels)

    def _set_operator(self, node: ast.Binary, left: Vector, right: Vector) -> Vector:
        if node.matching.group:
            raise ValueError(f"{node.op} takes no grouping")
        a, b = (x.rows.withColumn("sig", self._signature(node.matching)) for x in (left, right))
        if node.op == "or":
            return Vector(vectors.set_or(a, b, ["sig"]).drop("sig"), False)
        return Vector((vectors.set_and if node.op == "and" else vectors.set_unless)(a, b, ["sig"]).drop("sig"), left.unique)

    def _vector_vector(self, node: ast.Binary, left: Vector, right: Vector) -> Vector:
        m, compare = node.matching, node.op in ast.COMPARISONS
        swapped = m.group == "group_right"
        many, one = (right, left) if swapped else (left, right)
        lhs, rhs = (F.col("r"), F.col("l")) if swapped else (F.col("l"), F.col("r"))
        if compare:
            hit = _COMPARE[node.op](lhs, rhs)
            value = hit.cast("double") if node.as_bool else F.when(hit, lhs)
        else:
            value = _ARITHMETIC[node.op](lhs, rhs)
        a = many.rows.withColumn("sig", self._signature(m))
        b = one.rows.withColumn("sig", self._signature(m)).withColumnRenamed("labels", "one_labels")
        rows = vectors.match(a, b, ["sig"], value, many_to_one=bool(m.group), include=["one_labels"])
        if compare and not node.as_bool:
            rows = rows.filter("value IS NOT NULL")
        keeps_name = compare and not node.as_bool
        if m.group:
            labels = F.col("labels") if keeps_name else _drop("__name__")
            if m.include:
                copied = F.map_filter(F.from_json("one_labels", _MAP), lambda k, v: k.isin(*m.include))
                labels = canonical(F.map_concat(F.map_filter(F.from_json(labels, _MAP), lambda k, v: ~k.isin(*m.include)), copied))
            return Vector(rows.select("t", labels.alias("labels"), "value"), False)
        if m.on:
            labels = _keep(m.labels)
        else:
            labels = _drop(*m.labels) if keeps_name else _drop("__name__", *m.labels)
        return Vector(rows.select("t", labels.alias("labels"), "value"), False)
