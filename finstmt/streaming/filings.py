"""Streams of filings and of model calls. Extensions: nothing here changes a batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, WINDOW_S, PAUSE_S = 15, 60, 30


def newest_corrections(filings: DataFrame) -> DataFrame:
    """The newest filing of each company, year and type; use output mode update or complete."""
    newest = F.max_by(F.struct("rcept_no", "report_nm", "rcept_dt"), F.struct("rcept_dt", "rcept_no"))
    return filings.groupBy("corp", "year", "kind").agg(newest.alias("r")).select("corp", "year", "kind", "r.*")


def calls_by_window(calls: DataFrame, seconds: int = WINDOW_S, late: str = "2 minutes") -> DataFrame:
    """Calls in each window of event time, and whether they exceed the limit; late calls count until the watermark."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n_calls"))
    return w.select(F.col("w.start").alias("window_start"), "n_calls", (F.col("n_calls") > LIMIT).alias("over_limit"))


def _waits(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    began, n = state.get if state.exists else (None, 0)
    for frame in frames:
        frame, waits = frame.sort_values("ts"), []
        for ts in frame["ts"]:
            t, wait = ts.timestamp(), 0.0
            if began is None or t - began >= WINDOW_S:
                began, n = t, 0
            if n >= LIMIT:
                wait, began, n = float(PAUSE_S), t + PAUSE_S, 0
            n += 1
            waits.append(wait)
        yield pd.DataFrame({"caller": key[0], "ts": frame["ts"], "wait_s": waits})
    state.update((began, n))


def call_waits(calls: DataFrame) -> DataFrame:
    """How long each call (caller, ts) has to wait under the rule: a window begins with its first call, is
    over after WINDOW_S seconds, and after LIMIT calls a pause of PAUSE_S begins the next one."""
    return calls.groupBy("caller").applyInPandasWithState(_waits, "caller string, ts timestamp, wait_s double", "began double, n int", "append", GroupStateTimeout.NoTimeout)
