"""Streams run to their end over small files."""

from datetime import datetime, timedelta

from finstmt.streaming import filings


def run(spark, df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_newest_correction_wins(spark, tmp_path):
    rows = [("c", 2022, "A001", "r1", "old", "20230301"), ("c", 2022, "A001", "r2", "new", "20230401"), ("d", 2022, "F001", "r3", "x", "20230101")]
    schema = "corp string, year int, kind string, rcept_no string, report_nm string, rcept_dt string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = run(spark, filings.newest_corrections(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "complete", "newest", tmp_path)
    assert sorted((r.corp, r.rcept_no) for r in out) == [("c", "r2"), ("d", "r3")]


def test_calls_wait_after_the_limit(spark, tmp_path):
    t = datetime(2024, 1, 1)
    calls = [("a", t + timedelta(seconds=i)) for i in range(17)] + [("a", t + timedelta(seconds=200)), ("b", t)]
    spark.createDataFrame(calls, "caller string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("caller string, ts timestamp").parquet(str(tmp_path / "in"))
    out = run(spark, filings.call_waits(stream), "append", "waits", tmp_path)
    assert sorted(r.wait_s for r in out) == [0.0] * 18 + [30.0]
    got = run(spark, filings.calls_by_window(stream), "append", "windows", tmp_path)
    assert [(r.n_calls, r.over_limit) for r in got] in ([(18, True)], [])
