"""How long calls have to wait under a limit of calls a window, exactly, for callers of any number of calls.

The rule goes call by call: a window begins with a call, is over once a call comes WINDOW_S or more after its begin, and
a call that finds LIMIT calls in the window waits PAUSE_S, after which the next window begins with it. What happens
after a call that begins a window depends on that call alone, and on whether it waited: the next window begins with the
first call after the window's end, or with the LIMIT-th call from here, whichever is earlier. So a chunk of a caller's
calls, whatever came before, is entered at one of its first LIMIT calls, waited or not, and is a map of these 2 * LIMIT
states to those of the next chunk. Chunks make their maps side by side, a caller's maps are composed in order (an
array of 2 * LIMIT numbers for each chunk), and then all chunks fill in their waits side by side, each from its own state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import settle

LIMIT, WINDOW_S, PAUSE_S = 15, 60, 30
#: Calls of a chunk.
CHUNK = 100_000
SECOND = 1_000_000


def _next(t: np.ndarray, at: int, waited: bool) -> tuple[int, bool]:
    """(call, waited) that begins the next window; the call may lie beyond t."""
    over = int(np.searchsorted(t, t[at] + (PAUSE_S * waited + WINDOW_S) * SECOND))
    return (over, False) if over <= at + LIMIT else (at + LIMIT, True)


def _walk(t: np.ndarray, n: int, state: int) -> tuple[list[tuple[int, bool]], int]:
    """Windows that begin among the first n calls from a state (2 * call + waited), and the state in the next chunk.

    t: times of the chunk and, behind n, of up to LIMIT calls more, without which none can lie between.
    """
    at, waited, found = state // 2, bool(state % 2), []
    while at < n:
        found.append((at, waited))
        at, waited = _next(t, at, waited)
    return found, 2 * (at - n) + waited


def _map(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("n")
    t, n = frame["t"].to_numpy(), int((~frame["ahead"]).sum())
    out = [_walk(t, n, s)[1] if s // 2 < n else s - 2 * n for s in range(2 * LIMIT)]
    return pd.DataFrame({"caller": frame["caller"].iloc[:1], "chunk": frame["chunk"].iloc[:1], "to": [out]})


def _composed(frame: pd.DataFrame) -> pd.DataFrame:
    frame, state, states = frame.sort_values("chunk"), 0, []
    for to in frame["to"]:
        states.append(state)
        state = int(to[state]) if state < 2 * LIMIT else state
    return pd.DataFrame({"caller": frame["caller"], "chunk": frame["chunk"], "state": states})


def _filled(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("n")
    t, n = frame["t"].to_numpy(), int((~frame["ahead"]).sum())
    wait = np.zeros(n)
    for at, waited in _walk(t, n, int(frame["state"].iloc[0]))[0]:
        wait[at] = PAUSE_S * waited
    return pd.DataFrame({"caller": frame["caller"].iloc[:n], "call_id": frame["call_id"].iloc[:n], "wait_s": wait})


def waits(calls: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """caller, call_id, wait_s of calls (caller, ts, call_id; calls of one time go by id, then as they come).

    A call without a time or caller waits for none and has no row. Calls are numbered within their caller by a sort by
    range, so no task holds more of a caller than a range or a chunk of its calls.
    """
    chunk = max(chunk, LIMIT)
    known = calls.where("caller IS NOT NULL AND ts IS NOT NULL").select("caller", "call_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.monotonically_increasing_id().alias("rid"))
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = settle(known.repartitionByRange(parts, "caller", "t", "call_id", "rid").withColumn("part", F.spark_partition_id()), "calls")
    here = order.groupBy("caller", "part").agg(F.count("*").alias("here"))
    before = here.select("caller", "part", F.coalesce(F.sum("here").over(Window.partitionBy("caller").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part", "caller").orderBy("t", "call_id", "rid"))
    n = order.withColumn("n", within).join(before, ["caller", "part"]).select("caller", "call_id", "t", (F.col("before") + F.col("n") - 1).alias("n"))
    n = settle(n.withColumn("chunk", F.floor(F.col("n") / chunk)), "calls-numbered")
    # The first calls of a chunk are seen by the one before it as well.
    seen = n.withColumn("ahead", F.lit(False)).unionByName(n.where((F.col("n") % chunk < LIMIT) & (F.col("chunk") > 0)).withColumn("chunk", F.col("chunk") - 1).withColumn("ahead", F.lit(True)))
    caller = calls.schema["caller"].dataType.simpleString()
    keys = f"caller {caller}, chunk bigint"
    several = n.where("chunk > 0").select("caller").distinct()
    maps = seen.join(several, "caller", "left_semi").groupBy("caller", "chunk").applyInPandas(_map, f"{keys}, to array<int>")
    states = maps.groupBy("caller").applyInPandas(_composed, f"{keys}, state int")
    started = seen.join(states, ["caller", "chunk"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
    return started.groupBy("caller", "chunk").applyInPandas(_filled, f"caller {caller}, call_id {calls.schema['call_id'].dataType.simpleString()}, wait_s double")
