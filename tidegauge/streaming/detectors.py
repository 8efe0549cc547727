"""Detectors over live buckets: the state of each series is kept between batches, so a signal comes once, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.kernels.control import H, K


def cusum(stream: DataFrame, key: str, centre: float, sigma: float, step_ms: int) -> DataFrame:
    """(key, ts_ms, up, down) where a side of the tabular CUSUM of a live series' buckets (key, ts_ms, value) exceeds its
    limit; both sides start anew then, and drain over missing steps. A bucket not later than the last one seen is late
    and left out, as the state has passed it: the rollup before gives final buckets alone."""
    kind = dict(stream.dtypes)[key]

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last = state.get if state.exists else (0.0, 0.0, None)
        rows = pd.concat(list(parts)).sort_values("ts_ms")
        out = []
        for ts, value in zip(rows["ts_ms"].tolist(), rows["value"].tolist(), strict=True):
            if last is not None and ts <= last:
                continue
            gap = 0 if last is None else max(0, (ts - last) // step_ms - 1)
            z, last = (value - centre) / sigma, ts
            up, down = (max(0.0, max(0.0, s - gap * K) + sign * z - K) for s, sign in ((up, 1), (down, -1)))
            if max(up, down) > H:
                out.append((name[0], ts, up, down))
                up = down = 0.0
        state.update((up, down, last))
        yield pd.DataFrame(out, columns=[key, "ts_ms", "up", "down"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts_ms long, up double, down double", "up double, down double, last long", "append", GroupStateTimeout.NoTimeout)
