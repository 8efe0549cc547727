"""Control charts: limits from a baseline, detectors with a state, and how often they would signal by chance."""

from __future__ import annotations

import functools
import math

import numpy as np

from tidegauge.kernels.series import ar1, mad, residuals, tau
from tidegauge.kernels.tails import normal_sf, poisson_sf

LAMBDA, L, K, H = 0.2, 3.0, 0.5, 5.0
MIN_BASELINE, MIN_EFFECTIVE, ALPHA = 30, 10, 0.01


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 1 - normal_sf(v))(x)


def _run_length(q: np.ndarray, start: int) -> float:
    """Mean steps until a chain leaves its transient states."""
    return float(np.linalg.solve(np.eye(len(q)) - q, np.ones(len(q)))[start])


@functools.lru_cache(maxsize=128)
def ewma_run_length(lam: float = LAMBDA, limit: float = L, shift: float = 0.0, scale: float = 1.0, half: int = 60) -> float:
    """In-control run length of the EWMA of N(shift, scale^2): its range is cut into cells, each a state."""
    bar = limit * math.sqrt(lam / (2 - lam))
    edges = np.linspace(-bar, bar, 2 * half + 2)
    centre = (edges[1:] + edges[:-1]) / 2
    reach = (edges[None, :] - (1 - lam) * centre[:, None]) / lam
    return _run_length(np.diff(_cdf((reach - shift) / scale), axis=1), half)


@functools.lru_cache(maxsize=128)
def cusum_run_length(k: float = K, h: float = H, shift: float = 0.0, scale: float = 1.0, cells: int = 120) -> float:
    """In-control run length of the two-sided CUSUM: a chain a side, whose rates of signals add."""

    def side(mean: float) -> float:
        width = h / (cells - 0.5)
        at = np.arange(cells) * width
        upper = at[None, :] + width / 2 - at[:, None] + k
        below = _cdf((upper - mean) / scale)
        return _run_length(np.diff(below, axis=1, prepend=0.0), 0)

    return 1 / (1 / side(shift) + 1 / side(-shift))


def ewma(z: np.ndarray, gaps: np.ndarray) -> list[int]:
    bar, e, out = L * math.sqrt(LAMBDA / (2 - LAMBDA)), 0.0, []
    for i in range(len(z)):
        e = e * (1 - LAMBDA) ** (gaps[i] + 1) + LAMBDA * z[i]
        if abs(e) > bar:
            out.append(i)
            e = 0.0
    return out


def cusum(z: np.ndarray, gaps: np.ndarray) -> list[int]:
    up = down = 0.0
    out = []
    for i in range(len(z)):
        up, down = (max(0.0, max(0.0, s - gaps[i] * K) + sign * z[i] - K) for s, sign in ((up, 1), (down, -1)))
        if max(up, down) > H:
            out.append(i)
            up = down = 0.0
    return out


def chart(p: np.ndarray, y: np.ndarray, baseline: np.ndarray) -> dict[str, float | str]:
    """Centre and limits from the baseline's points alone, then what three detectors say of the rest. Significant
    autocorrelation moves the detectors to the AR(1) residuals. A detector's p is the Poisson tail of its signals against
    the rate under a centre and a spread at the ends of their 95 % intervals; the process is in control while each has
    at least a third of alpha."""
    base = y[baseline]
    none = {"centre": math.nan, "sigma": math.nan, "low": math.nan, "high": math.nan, "phi": math.nan, "beyond": 0, "ewma": 0, "cusum": 0, "p": math.nan}
    if len(base) < MIN_BASELINE:
        return none | {"verdict": "insufficient_baseline"}
    n_eff = len(base) / tau(p[baseline] - p[baseline][0], base)
    centre, sigma = float(np.median(base)), mad(base)
    if n_eff < MIN_EFFECTIVE or not sigma:
        return none | {"verdict": "insufficient_baseline"}
    phi, n_pairs = ar1(p[baseline] - p[baseline][0], base - centre)
    z, places, judged = (y - centre) / sigma, p, ~baseline
    if n_pairs and abs(phi) > 2 / math.sqrt(n_pairs):
        known, e = residuals(p - p[0], y - centre, phi)
        spread = mad(e[baseline[known]])
        if spread:
            z, places, judged = e / spread, p[known], judged[known]
    z, places = z[judged], places[judged]
    gaps = np.maximum(0, np.diff(places, prepend=places[:1] - 1) - 1)
    beyond, by_ewma, by_cusum = int((np.abs(z) > 3).sum()), len(ewma(z, gaps)), len(cusum(z, gaps))
    shift, scale = round(1.96 * 1.2533 / math.sqrt(n_eff) / 2, 2), round(1 + 1.96 * math.sqrt(1.3605 / n_eff) / 2, 2)
    rates = (normal_sf((3 - shift) / scale) + normal_sf((3 + shift) / scale), 1 / ewma_run_length(shift=shift, scale=scale), 1 / cusum_run_length(shift=shift, scale=scale))
    ps = [poisson_sf(k, len(z) * r) for k, r in zip((beyond, by_ewma, by_cusum), rates, strict=True)]
    verdict = "in_control" if min(ps) >= ALPHA / 3 else "out_of_control"
    return {"centre": centre, "sigma": sigma, "low": centre - 3 * sigma, "high": centre + 3 * sigma, "phi": phi, "beyond": beyond, "ewma": by_ewma, "cusum": by_cusum, "p": min(1.0, 3 * min(ps)), "verdict": verdict}
