"""Registered queries of the engine: name -> (Spark query, DuckDB oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: enter a query under a name, with its oracle if SQL can express it."""

    def enter(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return enter


def _load() -> None:
    from tidegauge.plans import cadence, catalogue, comparisons, discovery, evidence, expressions, histograms, kernels, metadata, shapes, special_values, streams  # noqa: F401  register on import


#: Rules shown on rows of their own, since events hold no case of them, and states on a fixed range of days. They are tested
#: as the others are, but no queries: their work does not grow with the tables.
EXAMPLES = frozenset(
    "fleet_missing_bounds ordered_unique merge_values_native native_schema le_parse outcome histogram_quantile_edges "
    "histogram_quantile_above_one division_edges rebucket_edges local_hour_of_week same_clock_time_before catalog_relations "
    "role_candidates name_tokens context_definitions context_claims exposition exposition_metadata inline_series table_matrix "
    "bucket_state_presence post_gap_flags state_coarsen state_group_merge coverage_per_series".split()
)


def queries() -> dict[str, Query]:
    _load()
    return {name: query for name, query in _QUERIES.items() if name not in EXAMPLES}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, sql in _ORACLES.items() if name not in EXAMPLES}


def examples() -> dict[str, tuple[Query, str]]:
    """name -> (query, SQL) of EXAMPLES."""
    _load()
    return {name: (_QUERIES[name], _ORACLES[name]) for name in sorted(EXAMPLES)}
