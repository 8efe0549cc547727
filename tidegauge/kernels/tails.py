"""Tail probabilities without SciPy: normal, Student's t, binomial, Poisson, Kolmogorov and Kuiper."""

from __future__ import annotations

import math
from collections.abc import Callable


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction on the side where it converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_isf(p: float, df: float) -> float:
    return _root(lambda t: t_sf(t, df) - p, -1e6, 1e6)


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Where a falling function crosses zero."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def poisson_sf(k: int, mean: float) -> float:
    """P(N >= k)."""
    return 1.0 if k <= 0 else 1 - gamma_q(k, mean)


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(N >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def kolmogorov_sf(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def kuiper_sf(x: float) -> float:
    if x < 0.4:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((4 * k * k * x * x - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
