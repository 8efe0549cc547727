"""Kernels run once a series: buckets (keys, ts_ms, value) in, one or several rows a series out.

A series of buckets is one group of a grouped map: a year of hours is 8,760 rows, so a group is small whatever the number
of series, and series are what Spark deals out. Raw samples must be rolled up first. A group over MAX_POINTS is refused,
not cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidegauge.kernels import control, groups, series, spectral

MAX_POINTS = 1_000_000


def _mapped(rows: DataFrame, keys: list[str], value: str, schema: str, kernel: Callable[[np.ndarray, np.ndarray], list[dict]], least: int = 2) -> DataFrame:
    """kernel(ts_ms, values) of each series, in order of time, without nulls and NaN; shorter series have no rows."""
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MAX_POINTS:
            raise ValueError(f"series {key} has {len(part)} points; roll it up to at most {MAX_POINTS}")
        part = part[part[value].notna()].sort_values("ts_ms")
        found = kernel(part["ts_ms"].to_numpy(), part[value].to_numpy(dtype=float)) if len(part) >= least else []
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | r for r in found], columns=[*keys, *names])

    return rows.select(*keys, "ts_ms", value).groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def _place(ts: np.ndarray, step: int) -> np.ndarray:
    return (ts - ts[0]) // step


def stability(rows: DataFrame, keys: list[str], value: str, step: int) -> DataFrame:
    """Autocorrelation time, effective points, trend, KPSS, variance ratio, shape and structure of each series."""

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        p = _place(ts, step)
        t, (stat, prob), form = series.trend(p, y), series.kpss(y), series.shape(y, int(series.tau(p, y)) + 1)
        kind, cuts = series.structure(p, y)
        return [{"n": len(y), "tau": series.tau(p, y), "slope": t["slope"], "slope_lo": t["low"], "slope_hi": t["high"], "slope_p": t["p"], "kpss": stat, "kpss_p": prob, "variance_ratio": series.variance_ratio(p, y), "skew": form["skew"], "kurtosis": form["kurtosis"], "bimodality": form["bimodality"], "structure": kind, "shifts": len(cuts)}]

    return _mapped(rows, keys, value, "n long, tau double, slope double, slope_lo double, slope_hi double, slope_p double, kpss double, kpss_p double, variance_ratio double, skew double, kurtosis double, bimodality double, structure string, shifts long", kernel, 16)


def changepoints(rows: DataFrame, keys: list[str], value: str, step: int) -> DataFrame:
    """(keys, ts_ms, before, after) where a new level begins."""

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        cuts = series.changepoints(_place(ts, step), y)
        edges = [0, *cuts, len(y)]
        return [{"ts_ms": int(ts[c]), "before": float(np.median(y[a:c])), "after": float(np.median(y[c:b]))} for a, c, b in zip(edges, cuts, edges[2:], strict=False)]

    return _mapped(rows, keys, value, "ts_ms long, before double, after double", kernel, 16)


def diagnosis(rows: DataFrame, keys: list[str], value: str, step: int) -> DataFrame:
    """One word a series, periods being confirmed against noise and red noise."""

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        peaks = [x for x in spectral.spectrum(ts, y, step) if x["fap"] < 0.01 and x["red_p"] < 0.01]
        return [{"verdict": series.diagnose(_place(ts, step), y, bool(peaks)), "period_ms": peaks[0]["period"] if peaks else None}]

    return _mapped(rows, keys, value, "verdict string, period_ms double", kernel)


def peaks(rows: DataFrame, keys: list[str], value: str, step: int, top: int = 5) -> DataFrame:
    return _mapped(rows, keys, value, "period double, power double, width double, fap double, red_p double", lambda ts, y: spectral.spectrum(ts, y, step, top), 8)


def spectrogram(rows: DataFrame, keys: list[str], value: str, step: int, width: int, periods_ms: list[float], overlap: float = 0.5) -> DataFrame:
    """(keys, ts_ms, period, power) of sliding segments."""
    freqs = 1 / np.array(periods_ms, dtype=float)

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        return [{"ts_ms": end, "period": p, "power": float(z)} for end, zs in spectral.spectrogram(ts, y, step, width, overlap, freqs) for p, z in zip(periods_ms, zs, strict=True)]

    return _mapped(rows, keys, value, "ts_ms long, period double, power double", kernel, 4)


def filtered(rows: DataFrame, keys: list[str], value: str, step: int, kind: str, low_ms: float | None = None, high_ms: float | None = None) -> DataFrame:
    """(keys, ts_ms, filtered, removed, edge) by a zero-phase filter over runs without gaps."""

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        spectral.check_filter(kind, low_ms, high_ms, step, float(ts[-1] - ts[0] + step))
        out, edge = spectral.apply_filter(_place(ts, step), y, kind, step, low_ms, high_ms)
        return [{"ts_ms": int(t), "filtered": float(a), "removed": float(b - a), "edge": bool(e)} for t, a, b, e in zip(ts, out, y, edge, strict=True)]

    return _mapped(rows, keys, value, "ts_ms long, filtered double, removed double, edge boolean", kernel)


def control_chart(rows: DataFrame, keys: list[str], value: str, step: int, baseline_end: int) -> DataFrame:
    """Limits from the points up to baseline_end, and what the detectors say of those after."""
    return _mapped(rows, keys, value, "centre double, sigma double, low double, high double, phi double, beyond long, ewma long, cusum long, p double, verdict string", lambda ts, y: [control.chart(_place(ts, step), y, ts <= baseline_end)])


def excursions(rows: DataFrame, keys: list[str], value: str, step: int, baseline_end: int) -> DataFrame:
    """The most unlikely run after baseline_end, for at most 512 points: all runs of a window are weighed."""

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        base, after = ts <= baseline_end, np.flatnonzero(ts > baseline_end)
        if base.sum() < 8 or not len(after):
            return []
        if len(after) > 512:
            raise ValueError("a window of at most 512 points is weighed; roll up further")
        found = series.excursion(y[base], y[after], base.sum() / series.tau(_place(ts[base], step), y[base]))
        ends = [int(ts[after[i]]) if i >= 0 else None for i in (found["start"], found["end"])]
        return [{"start": ends[0], "end": ends[1], "z": found["z"], "p": found["p"]}]

    return _mapped(rows, keys, value, "start long, end long, z double, p double", kernel)


def _matrix(part: pd.DataFrame, member: str, value: str) -> tuple[list, np.ndarray]:
    wide = part.pivot_table(index=member, columns="ts_ms", values=value, aggfunc="mean").sort_index()
    return wide.index.tolist(), wide.to_numpy(dtype=float)


def fleet_outliers(rows: DataFrame, fleet: list[str], member: str, value: str) -> DataFrame:
    """(fleet, member, kind, score): one group a fleet, whose matrix of members by steps is compared as a whole."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, x = _matrix(part, member, value)
        return pd.DataFrame([dict(zip(fleet, key, strict=True)) | {member: names[i], "kind": kind, "score": s} for i, kind, s in groups.outliers(x)], columns=[*fleet, member, "kind", "score"])

    return rows.select(*fleet, member, "ts_ms", value).groupBy(*fleet).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*fleet, member]) + ", kind string, score double")


def fleet_groups(rows: DataFrame, fleet: list[str], member: str, value: str) -> DataFrame:
    """(fleet, member, group): members by how they deviate over time."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, x = _matrix(part, member, value)
        own = groups.clusters(groups.features(groups.deviations(x)))
        return pd.DataFrame([dict(zip(fleet, key, strict=True)) | {member: m, "group": int(g)} for m, g in zip(names, own, strict=True)], columns=[*fleet, member, "group"])

    return rows.select(*fleet, member, "ts_ms", value).groupBy(*fleet).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*fleet, member]) + ", group long")


def seasonal(rows: DataFrame, keys: list[str], value: str, step: int, start: int, end: int, shift: int, k: int) -> DataFrame:
    """The window (start, end] against the same one of k earlier cycles."""
    n = (end - start) // step

    def kernel(ts: np.ndarray, y: np.ndarray) -> list[dict]:
        windows = np.full((k + 1, n), np.nan)
        for j in range(k + 1):
            own = (ts > start - j * shift) & (ts <= end - j * shift)
            windows[j, (ts[own] - (start - j * shift)) // step - 1] = y[own]
        return [groups.seasonal(windows[0], windows[1:])]

    return _mapped(rows, keys, value, "verdict string, p_level double, p_band double, cycles long", kernel)


def littles_law(rows: DataFrame, keys: list[str], step_s: float) -> DataFrame:
    """rows (keys, ts_ms, arrivals, latency_sum, latency_count, level): does the level equal the arrival rate times the
    mean latency?"""
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts_ms")
        found = groups.littles(*(part[c].to_numpy(dtype=float) for c in ("arrivals", "latency_sum", "latency_count", "level")), step_s)
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | found], columns=[*keys, "verdict", "ratio", "low", "high"])

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, verdict string, ratio double, low double, high double")
