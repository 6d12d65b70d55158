"""Snapshots that batches are merged into, and the registry as of a time."""

from datetime import datetime

from pyspark.sql import functions as F

from finstmt.sources import registry
from finstmt.streaming import snapshot

ROWS = [("c", 2022, "A001", "r1", "old", "20230301"), ("c", 2022, "A001", "r3", "newest", "20230501"), ("d", 2022, "F001", "r4", "x", "20230101"), ("c", 2023, "A001", "r5", "y", "20240101")]


def frame(spark, rows):
    return spark.createDataFrame(rows, snapshot.FILING)


def state(kept, version=None):
    return sorted((r.corp, r.year, r.rcept_no) for r in kept.read(version).collect())


def test_batches_merge_once_and_late_corrections_find_their_place(spark, tmp_path):
    kept = snapshot.corrections(spark, f"file://{tmp_path}", 4)
    assert state(kept) == []
    assert kept.merge(frame(spark, ROWS[:2]), 0)
    assert kept.merge(frame(spark, [*ROWS[2:], ("c", 2022, "A001", "r2", "late", "20230401")]), 3)  # older than what is there
    want = [("c", 2022, "r3"), ("c", 2023, "r5"), ("d", 2022, "r4")]
    assert state(kept) == want and state(kept, 0) == state(kept, 2) == want[:1]
    for old in (0, 2, 3):
        assert not kept.merge(frame(spark, [("c", 2022, "A001", "r9", "again", "20990101")]), old)
    assert state(kept) == want
    assert kept.merge(frame(spark, [("c", 2022, "A001", "r8", "later", "20230601"), ("c", 2022, "A001", "r8", "later", "20230601")]), 4)
    assert state(kept) == [("c", 2022, "r8"), *want[1:]]


def test_a_batch_that_was_cut_off_is_written_over(spark, tmp_path):
    kept = snapshot.corrections(spark, f"file://{tmp_path}", 4)
    kept.merge(frame(spark, ROWS[:1]), 0)
    frame(spark, [("z", 1, "A001", "half", "x", "1")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/data/v=1")  # rows, no manifest
    frame(spark, []).write.parquet(f"{tmp_path}/manifests/v=2")
    (tmp_path / "manifests/v=2/_SUCCESS").unlink()  # a manifest that was not ended
    assert state(kept) == [("c", 2022, "r1")] and kept.versions() == [0]
    assert kept.merge(frame(spark, ROWS[1:]), 1) and "half" not in {x[2] for x in state(kept)} and len(state(kept)) == 3


def test_only_touched_buckets_are_written_and_old_ones_go(spark, tmp_path):
    kept = snapshot.corrections(spark, f"file://{tmp_path}", 16)
    kept.merge(frame(spark, [(f"c{i}", 2022, "A001", f"r{i}", "", "20230101") for i in range(200)]), 0)
    kept.merge(frame(spark, [("c7", 2022, "A001", "s7", "", "20230102")]), 1)
    assert list(kept.manifest().values()).count(1) == 1 and len(kept.manifest()) == 16
    before = state(kept)
    assert kept.vacuum() == 1 and kept.vacuum() == 0 and state(kept) == before and kept.versions() == [1]
    assert kept.manifest(0) == {}
    assert kept.merge(frame(spark, [("c8", 2022, "A001", "s8", "", "20230102")]), 2)


def test_a_stream_of_filings_is_merged(spark, tmp_path):
    kept = snapshot.corrections(spark, f"file://{tmp_path}/kept", 4)
    for part in (ROWS[1:3], ROWS[:1], ROWS[3:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(snapshot.FILING).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(kept.sink()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert state(kept) == [("c", 2022, "r3"), ("c", 2023, "r5"), ("d", 2022, "r4")] and kept.versions() == [0, 1, 2]


REQUEST = "name string, at timestamp"


def answers(df):
    return {(r["name"], r["at"].hour + 24 * r["at"].day): (r["n_exact"], r["corp_code"]) for r in df.collect()}


def test_registry_as_of(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    rows = lambda *names: spark.createDataFrame([(f"{n}{i}", n, i) for i, n in enumerate(names)], registry.COLUMNS)
    registry.take(rows("a", "b", "b"), "2024-01-01 06:00:00", root)
    registry.take(rows("a"), "2024-01-02 03:00:00", root)
    registry.take(rows("zz"), "2024-01-02 03:00:00", root)  # taken again
    registry.take(rows("b"), "2024-01-09 00:00:00", root)
    asked = spark.createDataFrame([(n, datetime(2024, 1, d, h)) for n, d, h in [("a", 1, 5), ("a", 1, 6), ("b", 2, 2), ("a", 2, 3), ("zz", 3, 2), ("zz", 3, 3), ("b", 9, 0)]] + [(None, datetime(2024, 1, 9, 1))], REQUEST)
    assert answers(registry.as_of(asked, root)) == {("a", 29): (None, None), ("a", 30): (1, "a0"), ("b", 50): (2, "b1"), ("a", 51): (0, None), ("zz", 74): (1, "zz0"), ("zz", 75): (None, None), ("b", 216): (1, "b0"), (None, 217): (0, None)}
    plan = registry.as_of(asked, root)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_running_stream_sees_new_versions(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    for day, code in ((1, "old"), (2, "new")):
        registry.take(spark.createDataFrame([(code, "a", 0)], registry.COLUMNS), f"2024-01-0{day} 00:00:00", root)
        spark.createDataFrame([("a", datetime(2024, 1, day, 12))], REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in")
        registry.answer_stream(stream, root, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.corp_code for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()) == ["new", "old"]
