"""A feed of events to consumers, each with a cursor of its own.

Intentional events are delivered at once, ambient ones ride along with the next intentional event behind them, internal ones
never. The cursor and the waiting ambient events of a (consumer, scope) are state of the stream: a batch that is run again
after a failure begins from the state before it, so nothing is delivered twice and nothing is lost. Waiting events can have a
time to live. A scope's events are in order of seq, which is why it is one key; scopes are apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

INTENTIONAL, AMBIENT, INTERNAL = "intentional", "ambient", "internal"
_DELIVERED = "consumer string, scope long, seq long, klass string, up_to long"


class _Cursor(StatefulProcessor):
    def __init__(self, wait_ms: int | None) -> None:
        self._wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._cursor = handle.getValueState("cursor", "seq long")
        self._waiting = handle.getListState("waiting", "seq long", self._wait_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cursor = self._cursor.get()[0] if self._cursor.exists() else -1
        events = {r[0]: AMBIENT for r in self._waiting.get()} if self._waiting.exists() else {}
        for part in rows:
            events |= {s: k for s, k in zip(part["seq"].tolist(), part["klass"].tolist(), strict=True) if k != INTERNAL}
        events = {s: k for s, k in events.items() if s > cursor}
        up_to = max((s for s, k in events.items() if k == INTENTIONAL), default=cursor)
        left = sorted(s for s in events if s > up_to)
        self._waiting.clear()
        if left:
            self._waiting.put([(s,) for s in left])
        if up_to > cursor:
            self._cursor.update((up_to,))
        sent = sorted(s for s in events if s <= up_to)
        yield pd.DataFrame({"consumer": [key[0]] * len(sent), "scope": [key[1]] * len(sent), "seq": sent, "klass": [events[s] for s in sent], "up_to": [up_to] * len(sent)})

    def close(self) -> None:
        pass


def deliver(events: DataFrame, consumers: list[str], wait_ms: int | None = None) -> DataFrame:
    """(consumer, scope, seq, klass, up_to) of a stream of events (scope, seq, klass), each delivered once to every consumer;
    up_to is the cursor behind the batch. wait_ms gives up ambient events that waited so long; that is a matter of the clock,
    so such a stream runs batches for ever and wants a trigger by time, not availableNow. Of events that repeat a seq one is delivered; one behind the cursor comes too late."""
    offered = events.select(F.explode(F.array(*[F.lit(c) for c in consumers])).alias("consumer"), F.col("scope").cast("long").alias("scope"), F.col("seq").cast("long").alias("seq"), "klass")
    return offered.groupBy("consumer", "scope").transformWithStateInPandas(statefulProcessor=_Cursor(wait_ms), outputStructType=_DELIVERED, outputMode="append", timeMode="None" if wait_ms is None else "ProcessingTime")
