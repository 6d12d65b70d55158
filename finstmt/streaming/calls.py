"""The exact rule of operators.calls over a stream: calls wait for the watermark, then go in order of their time.

State of a caller is the begin of its window, the calls in it, and the calls that the watermark has not passed; a timer
at the first of them wakes the caller. So late calls within the watermark's bound take their place, results don't depend
on how the stream is cut into batches, and a restarted query goes on from its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.calls import LIMIT, PAUSE_S, SECOND, WINDOW_S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "caller string, call_id bigint, wait_s double"


class _Waits(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "began bigint, n int")
        self.waiting = handle.getListState("waiting", "t bigint, call_id bigint")

    def _due(self, key, passed_ms: int) -> Iterator[pd.DataFrame]:
        """Waits of the calls that the watermark has passed; a timer for the first of the rest."""
        calls = sorted((int(t), int(i)) for t, i in self.waiting.get())
        ready = [c for c in calls if c[0] // 1000 < passed_ms]
        began, n = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for t, call_id in ready:
            wait = 0
            if began is None or t - began >= WINDOW_S * SECOND:
                began, n = t, 0
            if n >= LIMIT:
                wait, began, n = PAUSE_S, t + PAUSE_S * SECOND, 0
            n += 1
            out.append((key[0], call_id, float(wait)))
        if ready:
            self.window.update((began, n))
        rest = calls[len(ready) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif calls:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["caller", "call_id", "wait_s"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList(list(zip(frame["t"].tolist(), frame["call_id"].tolist(), strict=True)))
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def waits(calls: DataFrame, late: str = "2 minutes") -> DataFrame:
    """caller, call_id, wait_s of a stream of calls (caller string, ts, call_id bigint), in output mode append.

    Calls later than the watermark (``late`` behind the newest) are left out; the last ones come out once newer calls of
    any caller have moved it past them. Needs spark.sql.streaming.stateStore.providerClass = STORE.
    """
    timed = calls.withWatermark("ts", late).select("caller", "call_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy("caller").transformWithStateInPandas(_Waits(), OUT, "append", "eventTime")
