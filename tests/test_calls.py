"""Exact waits of calls: in batch against the rule call by call, and as a stream against the batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finstmt.operators import calls
from finstmt.streaming import calls as stream

START = datetime(2024, 1, 1)
CALLS = "caller string, ts timestamp, call_id bigint"


def by_rule(rows):
    out, state = {}, {}
    for caller, ts, i in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        began, n = state.get(caller, (None, 0))
        wait = 0
        if began is None or (ts - began).total_seconds() >= 60:
            began, n = ts, 0
        if n >= 15:
            wait, began, n = 30, ts + timedelta(seconds=30), 0
        state[caller] = (began, n + 1)
        out[caller, i] = float(wait)
    return out


def some_calls(n, seed):
    r = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += r.choice([0, 0.3, 1, 2, 2, 2, 5, 29.9999, 30, 60, 61]) if r.random() < 0.3 else r.random() * 2
        out.append((r.choice(["hot", "hot", "hot", "b", "c"]), START + timedelta(seconds=round(t, 4)), i))
    return out


@pytest.mark.parametrize("chunk,parts", [(15, 4), (16, 7), (40, 200), (10_000, 3)])
def test_waits_of_chunks_are_those_of_the_rule(spark, chunk, parts):
    rows = some_calls(900, chunk)
    extra = [("hot", None, -1), (None, START, -2), ("one", START, -3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = calls.waits(spark.createDataFrame(rows + extra, CALLS).repartition(3), chunk).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = by_rule(rows + extra)
    assert {(r.caller, r.call_id): r.wait_s for r in got} == want and len(got) == len(want) and sum(w > 0 for w in want.values()) > 3


def test_nobody_calls(spark):
    assert calls.waits(spark.createDataFrame([], CALLS)).collect() == []


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    try:
        rows = some_calls(240, 9)
        late = rows[50]
        files = [rows[:50] + rows[51:90], [late, *rows[90:180]], rows[180:], [("end", rows[-1][1] + timedelta(hours=1), 10_000)]]
        seen = {}
        for i, part in enumerate(files):  # each file is a run of its own that goes on from the checkpoint
            spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            found = stream.waits(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), "10 minutes")
            q = found.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            seen[i] = spark.read.parquet(str(tmp_path / "out")).count() if i else 0
        out = {(r.caller, r.call_id): r.wait_s for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        batch = {(r.caller, r.call_id): r.wait_s for r in calls.waits(spark.createDataFrame(rows, CALLS)).collect()}
        assert out == batch == by_rule(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_hot_caller_is_dealt_out(spark):
    rows = spark.range(30_000).select(F.lit("hot").alias("caller"), (F.lit(START) + F.make_dt_interval(secs=F.col("id") * 3)).alias("ts"), F.col("id").alias("call_id"))
    got = calls.waits(rows, 1000)
    want = by_rule([("hot", START + timedelta(seconds=3 * i), i) for i in range(30_000)])
    assert {(r.caller, r.call_id): r.wait_s for r in got.collect()} == want
