"""The archive data source: partitions, ranks, limits, and the way there and back."""

import os
import pickle
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import Row

from finstmt.sources import archive, shred

MEMBERS = "rcept_no string, member string, content binary"


def noise(n, seed=0):
    return random.Random(seed).randbytes(n)


def test_there_and_back(spark, tmp_path):
    rows = [(f"R{i}", f"m{j}.xml", noise(100 * (j + 1), i + j)) for i in range(20) for j in range(i % 4 + 1)]
    root = f"file://{tmp_path}/a"
    shred.write_archives(spark.createDataFrame(rows, MEMBERS).repartition(5), root)
    got = shred.archives(spark, root).collect()
    assert sorted((r.rcept_no, r.member, bytes(r.content)) for r in got) == sorted(rows)
    assert all(r.size == len(r.content) for r in got) and {(r.rcept_no, r.rank) for r in got if r.member == "m0.xml"} == {(f"R{i}", i % 4 + 1) for i in range(20)}
    assert sorted(os.listdir(tmp_path / "a")) == sorted(f"R{i}.zip" for i in range(20))  # nothing of an attempt is left


def test_a_large_archive_is_read_by_member(spark, tmp_path):
    shred.write_archives(spark.createDataFrame([("big", f"m{j}", noise(3000, j)) for j in range(5)] + [(f"s{i}", "m", b"x" * 50) for i in range(40)], MEMBERS), f"file://{tmp_path}")
    df = shred.archives(spark, f"file://{tmp_path}", split_bytes=5000)
    shares = archive._Reader({"path": f"file://{tmp_path}", "splitbytes": "5000"}).partitions()
    assert [s.rank for s in shares if s.rank] == [1, 2, 3, 4, 5] and all(len(s.paths) == 1 for s in shares if s.rank) and sum(len(s.paths) for s in shares if not s.rank) == 40
    assert df.rdd.getNumPartitions() == len(shares) and df.count() == 45


def test_limits_and_broken_archives(spark, tmp_path):
    shred.write_archives(spark.createDataFrame([("fine", "m", b"x"), ("large", "m", noise(5000))], MEMBERS), f"file://{tmp_path}")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "large.zip").read_bytes()[:2000])
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    (tmp_path / "other.txt").write_text("x")
    assert [(r.rcept_no, r.rank) for r in shred.archives(spark, f"file://{tmp_path}", most_bytes=3000).collect()] == [("fine", 1)]
    assert [r.rcept_no for r in shred.archives(spark, f"file://{tmp_path}", split_bytes=1).orderBy("rcept_no").collect()] == ["fine", "large"]
    os.makedirs(tmp_path / "none")
    assert shred.archives(spark, f"file://{tmp_path}/none").count() == 0


def test_an_archive_in_two_pieces_is_refused(spark, tmp_path):
    spark.dataSource.register(archive.FilingArchives)
    rows = spark.createDataFrame([("a", "m1", b"1"), ("b", "m", b"2"), ("a", "m2", b"3")], MEMBERS).coalesce(1)
    with pytest.raises(Exception, match="repartition by rcept_no"):
        rows.write.format("filing_archives").mode("append").save(f"file://{tmp_path}/a")
    assert os.listdir(tmp_path / "a") == []


def test_written_again_an_archive_is_replaced(spark, tmp_path):
    for content in (b"old", b"new"):
        shred.write_archives(spark.createDataFrame([("a", "m", content)], MEMBERS), f"file://{tmp_path}")
    assert [bytes(r.content) for r in shred.archives(spark, f"file://{tmp_path}").collect()] == [b"new"]


def members_of(keys):
    return iter([Row(rcept_no=k, member="m", content=b"x") for k in keys])


def peak_of(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_the_driver_holds_little_of_many_archives(tmp_path):
    n = 6_000
    writer = archive._Writer({"path": f"file://{tmp_path}", "folders": "3"})
    told = [writer.write(members_of(f"Supplier#{i:09d}~2001" for i in range(at, n, 3))) for at in range(3)]
    assert sum(len(pickle.dumps(m)) for m in told) < 1_500
    _, most = peak_of(lambda: writer.commit(told))
    assert most < 200 * n  # a rename handed to the pool takes over 1,000 bytes
    assert sorted(os.listdir(tmp_path)) == ["00000", "00001", "00002"] and sum(len(x) for _, _, x in os.walk(tmp_path)) == n
    shares, most = peak_of(archive._Reader({"path": f"file://{tmp_path}"}).partitions)
    assert len(shares) == 1 and len(set(shares[0].paths)) == n and all(map(os.path.isfile, shares[0].paths))
    assert len(pickle.dumps(shares)) < 12 * n


def test_shares_span_folders_on_any_file_system(tmp_path):
    writer = archive._Writer({"path": f"file://{tmp_path}", "folders": "5"})
    writer.commit([writer.write(members_of(f"R{i}" for i in range(50)))])
    where, root = archive.fs.FileSystem.from_uri(f"file://{tmp_path}")
    found = list(archive._listed(where, root))
    assert sorted(found) == sorted(archive._listed(archive.fs.SubTreeFileSystem(root, where), "")) and len(found) == 50
    assert len(archive._Reader({"path": f"file://{tmp_path}", "splitbytes": f"{10 * found[0][1] + 9}"}).partitions()) in (5, 6)


def test_lists_of_tasks_are_read_piece_by_piece(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "LISTED", 4)
    monkeypatch.setattr(archive, "BLOCK", 7)
    writer = archive._Writer({"path": f"file://{tmp_path}"})
    a, b = writer.write(members_of(f"가{9 - i}" for i in range(10))), writer.write(members_of(["나\n", "a b"]))
    assert (len(a.lists), len(b.lists)) == (3, 1)
    again = writer.write(members_of(["나\n"]))
    with pytest.raises(ValueError, match="repartition by rcept_no"):
        writer.commit([a, None, b, again])
    writer.abort([again])
    writer.commit([a, None, b])
    assert sorted(os.listdir(tmp_path)) == sorted([*(f"가{i}.zip" for i in range(10)), "나\n.zip", "a b.zip"])


def test_what_a_broken_commit_left_is_removed(tmp_path):
    writer = archive._Writer({"path": f"file://{tmp_path}"})
    a, b = writer.write(members_of("xyz")), writer.write(members_of("uvw"))
    for m, k in ((a, "x"), (b, "u")):
        where = archive.fs.LocalFileSystem()
        to, name = next(f for f in archive._lines(where, m.lists[0]) if f[0].endswith(f"/{k}.zip"))
        where.move(name, to)
    os.remove(b.lists[0].removeprefix("file://"))
    writer.abort([a, b, None])
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["u.zip", "x.zip"] and not any(x.startswith((".y", ".z")) or x.endswith(".list") for x in os.listdir(tmp_path))
