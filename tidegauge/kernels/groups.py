"""Kernels over several series of one time: fleets, behaviour groups, cycles, queues and verdicts."""

from __future__ import annotations

import math

import numpy as np

from tidegauge.kernels.series import mad, tau
from tidegauge.kernels.tails import binomial_sf, poisson_sf, t_isf, t_sf

ALPHA, REACH, MIN_MEMBERS, MIN_PART, MAX_GROUPS = 0.01, 6, 10, 5, 6


def deviations(x: np.ndarray) -> np.ndarray:
    """(members, steps): each value's distance from the median of the others at its step, by the robust spread of all such
    distances within six steps."""
    out = np.full(x.shape, np.nan)
    for s in range(x.shape[1]):
        known = np.flatnonzero(~np.isnan(x[:, s]))
        ranked = np.sort(x[known, s])
        n = len(ranked)
        if n < 3:
            continue
        place = np.searchsorted(ranked, x[known, s])
        m = n - 1
        pick = lambda i: ranked[np.where(i >= place, i + 1, i)]  # noqa: E731  the i-th of the others
        out[known, s] = x[known, s] - (pick(np.full(n, (m - 1) // 2)) + pick(np.full(n, m // 2))) / 2
    spread = np.array([_scale(out[:, max(0, s - REACH) : s + REACH + 1]) for s in range(x.shape[1])])
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / spread


def _scale(d: np.ndarray) -> float:
    d = d[~np.isnan(d)]
    if not len(d):
        return math.nan
    return mad(d) or float(np.mean(np.abs(d))) * 1.2533 or math.nan


def trimmed(z: np.ndarray, share: float = 0.2) -> float:
    z = np.sort(z[~np.isnan(z)])
    cut = int(len(z) * share)
    return float(z[cut : len(z) - cut].mean()) if len(z) > 2 * cut else math.nan


def outliers(x: np.ndarray) -> list[tuple[int, str, float]]:
    """(member, kind, score) of members unlike the others, at a family-wise alpha over three tests: persistent by its
    trimmed mean deviation, drifting by the last third against the first, transient by its farthest rolling median over
    five steps."""
    k, steps = x.shape
    if k < MIN_MEMBERS:
        return []
    z = deviations(x)
    third = max(1, steps // 3)
    roll = np.array([[np.nanmedian(r[max(0, s - 2) : s + 3]) if not np.isnan(r[max(0, s - 2) : s + 3]).all() else math.nan for s in range(steps)] for r in z])
    stats = {
        "persistent": np.array([trimmed(r) for r in z]),
        "drifting": np.array([trimmed(r[-third:]) - trimmed(r[:third]) for r in z]),
        "transient": np.array([r[np.nanargmax(np.abs(r))] if not np.isnan(r).all() else math.nan for r in roll]),
    }
    found: dict[int, tuple[str, float]] = {}
    for kind, v in stats.items():
        others = [np.delete(v, i) for i in range(k)]
        score = np.array([(v[i] - np.nanmedian(o)) / (mad(o[~np.isnan(o)]) or math.nan) for i, o in enumerate(others)])
        bar = t_isf(ALPHA / 3 / (2 * k), max(1.0, 0.3675 * (k - 1)))
        for i in np.flatnonzero(np.abs(np.nan_to_num(score)) > bar).tolist():
            found.setdefault(i, (kind, float(score[i])))
    return [(i, kind, s) for i, (kind, s) in sorted(found.items())]


def two_means(x: np.ndarray, rng: np.random.Generator, starts: int = 4, rounds: int = 50) -> tuple[np.ndarray, float]:
    """The better of several 2-means, and its cluster index: the share of the variance that stays within."""
    best, total = None, float(np.square(x - x.mean(axis=0)).sum())
    for _ in range(starts):
        first = x[rng.integers(len(x))]
        far = np.square(x - first).sum(axis=1)
        if far.sum() == 0:
            return np.zeros(len(x), dtype=int), 1.0
        c = np.stack([first, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(rounds):
            own = np.square(x[:, None] - c).sum(axis=2).argmin(axis=1)
            new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in (0, 1)])
            if np.allclose(new, c):
                break
            c = new
        inside = float(np.square(x - c[own]).sum())
        if best is None or inside < best[1]:
            best = (own, inside)
    return best[0], best[1] / total if total else 1.0


def clusters(x: np.ndarray, null: int = 200, seed: int = 0) -> np.ndarray:
    """Group numbers by recursive 2-means. A split stands if none of null simulated normal clouds of the same covariance
    splits as well, and both parts have at least five members."""
    rng, own, open_ = np.random.default_rng(seed), np.zeros(len(x), dtype=int), [0]
    while open_ and own.max() + 1 < MAX_GROUPS:
        g = open_.pop(0)
        at = np.flatnonzero(own == g)
        if len(at) < 2 * MIN_PART:
            continue
        side, index = two_means(x[at], rng)
        if min(np.bincount(side, minlength=2)) < MIN_PART:
            continue
        cov = np.atleast_2d(np.cov(x[at].T)) + 1e-12 * np.eye(x.shape[1])
        if any(two_means(rng.multivariate_normal(np.zeros(x.shape[1]), cov, len(at)), rng, 1)[1] <= index for _ in range(null)):
            continue
        own[at[side == 1]] = own.max() + 1
        open_ += [g, int(own.max())]
    return own


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two groupings: 1 for the same, 0 for chance."""
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    choose = lambda n: (n * (n - 1) / 2).sum()
    both, rows, cols = choose(table), choose(table.sum(axis=1)), choose(table.sum(axis=0))
    chance = rows * cols / max(1.0, len(a) * (len(a) - 1) / 2)
    return float((both - chance) / ((rows + cols) / 2 - chance)) if (rows + cols) / 2 != chance else 1.0


def features(z: np.ndarray, blocks: int = 8) -> np.ndarray:
    """Trimmed mean deviations in blocks of time; unknown ones are 0."""
    return np.nan_to_num(np.array([[trimmed(part) for part in np.array_split(r, blocks)] for r in z]))


def level_test(now: float, before: np.ndarray, alpha: float = ALPHA) -> dict[str, float]:
    """Is a level within the prediction interval of the levels of earlier windows?"""
    k = len(before)
    if k < 3:
        return {"low": math.nan, "high": math.nan, "p": math.nan}
    mid, sd = float(before.mean()), float(before.std(ddof=1)) * math.sqrt(1 + 1 / k)
    reach = t_isf(alpha / 2, k - 1) * sd
    p = 2 * t_sf(abs(now - mid) / sd, k - 1) if sd else float(now == mid)
    return {"low": mid - reach, "high": mid + reach, "p": min(1.0, p)}


def seasonal(now: np.ndarray, past: np.ndarray) -> dict[str, float | str]:
    """A window against the same one of earlier cycles (cycles, steps): by level and by the share of points outside the
    band of the cycles; on a log scale where all is positive."""
    kept = past[(~np.isnan(past)).mean(axis=1) >= 0.5]
    if len(kept) < 3 or np.isnan(now).all():
        return {"verdict": "insufficient_history", "p_level": math.nan, "p_band": math.nan, "cycles": len(kept)}
    if np.nanmin(kept) > 0 and np.nanmin(now) > 0:
        kept, now = np.log(kept), np.log(now)
    centre = np.nanmedian(kept, axis=0)
    rest = kept - centre
    level = level_test(float(np.nanmean(now - centre)), np.nanmean(rest, axis=1))
    factor = math.sqrt((1 + 1.57 / len(kept)) / (1 - 1 / len(kept)))
    low, high = np.nanquantile(rest, [0.05, 0.95]) * factor
    own = (now - centre)[~np.isnan(now - centre)]
    outside = int(((own < low) | (own > high)).sum())
    n_eff = max(1, round(len(own) / tau(np.arange(len(own)), own)))
    p_band = binomial_sf(round(outside / max(1, len(own)) * n_eff), n_eff, 0.1)
    return {"verdict": "unusual" if min(level["p"], p_band) < ALPHA / 2 else "usual", "p_level": level["p"], "p_band": p_band, "cycles": len(kept)}


def judge_counts(now: float, exposure: float, before: float, before_exposure: float, phi: float = 1.0) -> dict[str, float]:
    """Events now against a reference rate, over-dispersion taken off both: the binomial tail of how all events fall on the
    two exposures, on the side of the change."""
    a, b, phi = now / max(phi, 1.0), before / max(phi, 1.0), max(phi, 1.0)
    share = exposure / (exposure + before_exposure)
    n = round(a + b)
    rate = (now / exposure) / (before / before_exposure) if before else math.inf
    tail = binomial_sf(round(a), n, share) if rate >= 1 else 1 - binomial_sf(round(a) + 1, n, share)
    return {"ratio": rate, "p": min(1.0, 2 * tail)}


def departure(events: float, opportunities: float, quiet_opportunities: float) -> float:
    """Events after a reference without any: the chance of so many at a rate the quiet time does not rule out."""
    return poisson_sf(round(events), 3.0 / quiet_opportunities * opportunities)


def littles(arrivals: np.ndarray, latency_sum: np.ndarray, latency_count: np.ndarray, level: np.ndarray, step_s: float) -> dict[str, float | str]:
    """L against lambda W over a window's steps: their ratio with an interval from the scatter of block ratios."""
    known = ~(np.isnan(arrivals) | np.isnan(latency_sum) | np.isnan(latency_count) | np.isnan(level)) & (latency_count > 0)
    if known.sum() < 8 or arrivals[known].sum() <= 0:
        return {"verdict": "insufficient_data", "ratio": math.nan, "low": math.nan, "high": math.nan}
    lam, w = arrivals[known].sum() / (known.sum() * step_s), latency_sum[known].sum() / latency_count[known].sum()
    ratio = float(level[known].mean() / (lam * w)) if lam * w > 0 else math.inf
    part = np.array_split(np.flatnonzero(known), 8)
    block = np.array([level[i].mean() / max(1e-300, latency_sum[i].sum() / latency_count[i].sum() * arrivals[i].sum() / (len(i) * step_s)) for i in part])
    reach = t_isf(0.005, 7) * float(block.std(ddof=1)) / math.sqrt(8)
    verdict = "holds" if ratio - reach <= 1 <= ratio + reach else "systematic_offset"
    return {"verdict": verdict, "ratio": ratio, "low": ratio - reach, "high": ratio + reach}
