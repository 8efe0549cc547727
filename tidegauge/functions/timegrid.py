"""Epoch milliseconds, durations and buckets that carry their END time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of the units a duration may name.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration(text: str) -> int:
    """Milliseconds of '1h30m' and the like: whole numbers, each with a unit, each unit once and the larger first."""
    rest, total, before = text, 0, None
    while rest:
        number = rest[: len(rest) - len(rest.lstrip("0123456789"))]
        unit = next((u for u in sorted(UNITS, key=len, reverse=True) if rest[len(number) :].startswith(u)), None)
        if not number or unit is None:
            raise ValueError(f"duration {text!r}: a number with one of {', '.join(UNITS)} is wanted at {rest!r}")
        if before is not None and UNITS[unit] >= UNITS[before]:
            raise ValueError(f"duration {text!r}: {unit} cannot follow {before}")
        total, before, rest = total + int(number) * UNITS[unit], unit, rest[len(number) + len(unit) :]
    if before is None:
        raise ValueError("a duration cannot be empty")
    return total


def bucket_end(ts_ms: Column, step: int) -> Column:
    """End of the bucket (end - step, end] that holds ts_ms."""
    return (F.ceil(ts_ms / F.lit(step)) * step).cast("long")


def bucket_end_left_closed(ts_ms: Column, step: int) -> Column:
    """End of the bucket [end - step, end) that holds ts_ms."""
    return (F.floor(ts_ms / F.lit(step)) * step + step).cast("long")


def windows_of(ts_ms: Column, step: int, width: int) -> Column:
    """All grid times t (multiples of step) whose window (t - width, t] holds ts_ms; one row each after explode()."""
    first = bucket_end(ts_ms, step)
    return F.when(first < ts_ms + width, F.sequence(first, ts_ms + (width - 1), F.lit(step).cast("long")))
