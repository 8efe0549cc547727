"""Arithmetic with IEEE semantics, where Spark's ANSI mode raises or returns null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def negative_zero(x: Column) -> Column:
    """Is x the zero with a sign? Spark compares it as equal to zero; only its text tells."""
    return x.cast("string") == "-0.0"


def div(a: Column, b: Column) -> Column:
    """a / b: x/0 is an infinity with the sign of x times that of the zero, 0/0 and NaN/0 are NaN."""
    signed = F.when((a > 0) != negative_zero(b), INF).otherwise(-INF)
    at_zero = F.when(a.isNull() | b.isNull(), None).when(F.isnan(a) | (a == 0), NAN).otherwise(signed)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; by zero it is NaN."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))


def ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def power(a: Column, b: Column) -> Column:
    """a ^ b; NaN where no real number is it, also for an overflow."""
    found = F.pow(a, b)
    return F.when(F.isnan(found) | ((F.abs(found) == INF) & (F.abs(a) != INF) & (F.abs(b) != INF) & (a != 0)), NAN).otherwise(found)


def same(a: Column, b: Column) -> Column:
    """a == b, false where either is NaN, which Spark holds equal to itself."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def log_of(x: Column, base: float) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(base, x))


def sqrt(x: Column) -> Column:
    return F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def round_to(x: Column, unit: float) -> Column:
    """Nearest multiple of unit, halves up; NaN and infinities stay, and a unit of 0 has no multiple but NaN."""
    if unit == 0 or unit != unit:
        return F.when(x.isNotNull(), F.lit(NAN))
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(F.floor(x / unit + 0.5) * unit)


def quantile(x: Column, q: float) -> Column:
    """Aggregate: the linear (type 7) quantile; -Inf for q < 0, +Inf for q > 1, NaN for q = NaN."""
    if q != q or not 0 <= q <= 1:
        return F.when(F.count(x) > 0, F.lit(NAN if q != q else -INF if q < 0 else INF))
    return F.percentile(x, F.lit(q))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a share; null for n = 0."""
    p = F.try_divide(successes, n)
    centre = (p + z * z / (F.lit(2.0) * n)) / (1 + F.lit(z * z) / n)
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n)) / (1 + F.lit(z * z) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))
