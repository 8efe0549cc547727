"""Aggregation requests over document tables: a body is checked, then becomes a DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import documents

# Metric aggregations, and what each gives.
METRICS = {"value_count": F.count, "sum": F.sum, "avg": F.avg, "stats": None, "percentiles": None}
MAX_GROUPS = 500


def parse(body: dict) -> tuple[list[str], str | None, str | None, float | None]:
    """(group fields, metric, field, percent) of a body {group?: [..], metric?: {kind: {field, percent?}}}; anything else is
    an error, since time belongs to the query and not to the body."""
    unknown = set(body) - {"group", "metric"}
    if unknown:
        raise ValueError(f"unknown parts of the request: {sorted(unknown)}")
    group = list(body.get("group", []))
    metric = body.get("metric")
    if metric is None:
        return group, None, None, None
    if len(metric) != 1 or next(iter(metric)) not in METRICS:
        raise ValueError(f"exactly one metric of {sorted(METRICS)}")
    kind, spec = next(iter(metric.items()))
    if set(spec) - {"field", "percent"} or "field" not in spec or (kind == "percentiles") != ("percent" in spec):
        raise ValueError("a metric has a field; percentiles have one percent as well")
    if kind == "percentiles" and not 0 < spec["percent"] < 100:
        raise ValueError("a percent lies between 0 and 100")
    return group, kind, spec["field"], spec.get("percent")


def fetch(docs: DataFrame, body: dict, step: int, runtime: dict[str, str] | None = None) -> DataFrame:
    """(group, ts_ms, value, ...) of a request. runtime names columns by SQL expressions. A metric's field must be numeric;
    more than MAX_GROUPS groups are refused, never cut."""
    group, kind, field, percent = parse(body)
    for name, expression in (runtime or {}).items():
        docs = docs.withColumn(name, F.expr(expression))
    types = dict(docs.dtypes)
    missing = [c for c in [*group, *([field] if field else [])] if c not in types]
    if missing:
        raise ValueError(f"unknown fields: {missing}")
    if field and not types[field].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")):
        raise ValueError(f"{field} is {types[field]}, a number is wanted")
    if group:
        documents.refuse_above(docs.select(*group).distinct(), MAX_GROUPS, "groups")
    seconds = step / 1000
    if kind is None:
        return documents.form(docs, group, step, value=F.count("*") / seconds)
    if kind in ("value_count", "sum"):
        return documents.form(docs, group, step, value=METRICS[kind](field) / seconds)
    if kind == "percentiles":
        return documents.form(docs, group, step, value=F.percentile(field, F.lit(percent / 100)), n=F.count(field))
    return documents.form(docs, group, step, value=F.avg(field), min=F.min(field), max=F.max(field), count=F.count(field))


def discover(docs: DataFrame) -> list[tuple[str, str]]:
    """(field, role) from the schema: metric for numbers, label for text and truth values, time for times."""
    role = lambda kind: "time" if kind.startswith("timestamp") else "label" if kind in ("string", "boolean") else "metric" if kind.startswith(("double", "float", "int", "bigint", "decimal")) else "other"
    return [(name, role(kind)) for name, kind in docs.dtypes]
