"""Token files, centroid clustering and periodic runs against brute force, and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finstmt.llm import centroids, periodic_runs, shared, token_files, tokens

from .conftest import frame, odd_rows, prose

SMALL = "/root/testdata/sf0.001"


# 11 token files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 3, 8, 64, 1024]))
def test_codec_keeps_any_values(values, block):
    v = np.array(values, np.uint64)
    words, sizes = token_files.encode(v, block)
    assert sizes.sum() == len(words) <= 2 * len(v)
    assert token_files.decode(words, np.concatenate([[0], np.cumsum(sizes)]), len(v), block).tolist() == values


def test_words_hold_as_many_values_as_fit():
    for bits, count in zip(token_files.BITS.tolist(), token_files.COUNTS.tolist(), strict=True):
        words, _ = token_files.encode(np.full(4 * count, (1 << bits) - 1, np.uint64), 4 * count)
        assert len(words) == 4 and set((words >> np.uint64(60)).tolist()) == {token_files.COUNTS.tolist().index(count)}
    words, _ = token_files.encode(np.full(5, 1 << 60, np.uint64))  # beyond 60 bits: an escape each
    assert len(words) == 10 and (words[::2] >> np.uint64(60) == 15).all()


def test_any_range_is_read_from_its_own_blocks(tmp_path):
    rng = np.random.default_rng(3)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, n)) for i, n in enumerate([0, 1, 5000, 3, 1024, 0, 2047, 1])]
    writer = token_files.FileWriter(f"file://{tmp_path}/a/b.s8b", 64)
    for d, v in docs:
        writer.add(d, v)
    path, n_ids, n_docs, size = writer.close()
    assert (n_ids, n_docs, size) == (sum(len(v) for _, v in docs), len(docs), (tmp_path / "a/b.s8b").stat().st_size)
    file, all_ids = token_files.FileReader(path), np.concatenate([v for _, v in docs])
    for _ in range(100):
        a, b = sorted(rng.integers(0, n_ids + 1, 2).tolist())
        assert (file.ids(a, b - a) == all_ids[a:b]).all()
    got = [(None if file.nulls[k] else int(file.docs[k]), v.tolist()) for k, _, v in file.documents()]
    assert got == [(d, v.tolist()) for d, v in docs]


def test_damaged_files_are_refused(tmp_path):
    writer = token_files.FileWriter(f"file://{tmp_path}/x")
    writer.add(1, np.arange(5000))
    writer.close()
    good = (tmp_path / "x").read_bytes()
    for bad in (good[:-1], b"", good[:60] + b"\x01" + good[61:], good[:-90] + b"\x07" + good[-89:]):
        (tmp_path / "x").write_bytes(bad)
        with pytest.raises(ValueError):
            list(token_files.FileReader(f"file://{tmp_path}/x").documents())


def by_hand(rows):
    """Results of rows in ascending order of ids, null first."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        v = np.array([*tokens.ids(t), 0], "<u4")
        out.append((i, at, len(v), zlib.crc32(v.tobytes())))
        at += len(v)
    return out


@pytest.mark.parametrize("parts,adaptive,file_ids", [(4, "true", 1 << 20), (7, "false", 100), (200, "true", 1)])
def test_files_round_trip(spark, odd, none, parts, adaptive, file_ids):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        root = shared.new_path(spark, "t")
        token_files.write(odd.repartition(5), root, file_ids=file_ids)
        rows = token_files.read(spark, root).collect()
        token_files.write(none, root + "-none")
        assert token_files.read(spark, root + "-none").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = by_hand([(i, t) for i, t, _ in odd_rows()])
    assert sorted((r.start, r.n_tokens) for r in rows) == [x[1:3] for x in want]  # rows of one id may stand in any order
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))) == sorted(str((i, n, c)) for i, _, n, c in want)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [x[0] for x in want]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in rows)


def test_files_of_lost_attempts_do_not_count(spark):
    root = shared.new_path(spark, "t")
    token_files.write(frame(spark, [(1, "one two", "s"), (2, "three", "s")]), root)
    stray = token_files.FileWriter(f"{root}/ids-000000-0000-stray.s8b")
    stray.add(3, np.arange(9))
    stray.close()
    assert sorted(r.doc_id for r in token_files.read(spark, root).collect()) == [1, 2]


def test_file_query_against_brute_force(spark):
    docs = shared.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    rows = token_files.op11_simple8b_token_files(spark, SMALL)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, rows.collect())) == by_hand([tuple(r) for r in docs])


# 12 centroids

VECTORS = "vec_id bigint, embedding array<double>, label int, v string, norms string, cluster string, distance string"


def brute_clusters(rows, k, rounds, dims):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) and abs(np.floor(256 * x)) <= 1 << 27 for x in e):
            kept.append((i, [int(np.floor(256 * x)) for x in e]))
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in start[:k]] or [[0] * dims]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        label = [near(v)[1] for _, v in kept]
        cs = [[sum(x) // len(mine) for x in zip(*mine, strict=True)] if (mine := [v for (_, v), c in zip(kept, label, strict=True) if c == j]) else old for j, old in enumerate(cs)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), cs


def some_vectors(n, dims, seed):
    r = np.random.default_rng(seed)
    middles = r.normal(0, 3, (5, dims))
    return [(int(i), (middles[i % 5] + r.normal(0, 0.2, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n,k,dims", [(200, 12, 64), (60, 7, 10), (5, 40, 3)])
def test_clusters_against_brute_force(spark, n, k, dims):
    rows = some_vectors(n, dims, n)
    rows += [(1000, None), (1001, [0.5] * (dims - 1)), (1002, [None] + [0.0] * (dims - 1)), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims), (1005, [1e300] * dims)]
    rows += [(None, [0.25] * dims), rows[0], rows[0], (3, [-0.001] * dims), (2000, [5e5] * dims), (2001, [-5e5] * dims)]
    df = spark.createDataFrame([(i, e, 1, *["x"] * 4) for i, e in rows], VECTORS).repartition(3)
    found, cs = centroids.cluster(df, k, 3, dims)
    want, want_cs = brute_clusters(rows, k, 3, dims)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == want and cs.tolist() == want_cs


def test_no_vectors(spark):
    for rows in ([], [(1, None)], [(None, [0.5] * 64)]):
        found, _ = centroids.cluster(spark.createDataFrame([(i, e, 1, *["x"] * 4) for i, e in rows], VECTORS))
        assert [(r.vec_id, r.cluster) for r in found.collect()] == [(i, 0) for i, e in rows if e]


def test_bounds_screen_and_lose_nothing():
    r = np.random.default_rng(5)
    middles = r.integers(-4000, 4000, (20, 64)) * np.repeat(r.integers(0, 2, (20, 8)), 8, axis=1)
    x = (middles[r.integers(0, 20, 500)] + r.integers(-50, 50, (500, 64))).astype(np.int32)
    label, best, n = centroids.nearest(x, centroids.norms(x), middles)
    exact = np.square(x[:, None].astype(np.int64) - middles).sum(axis=2)
    assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and n.mean() < 5
    same = np.array([[3] * 64] * 4)
    assert centroids.nearest(np.array([[3] * 64, [7] * 64], np.int32), centroids.norms(np.array([[3] * 64, [7] * 64])), same)[0].tolist() == [0, 0]


# 13 periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    r = random.Random(1)
    n_runs = 0
    for _ in range(1500):
        n = r.randrange(0, 160)
        w = [b"%d" % r.randrange(r.choice([1, 2, 2, 3, 5, 20])) for _ in range(n)]
        for _ in range(r.randrange(0, 4)):
            if n > 8:
                s, p = r.randrange(n), r.randrange(1, 1 + max(1, n // 4))
                w = w[:s] + w[s : s + p] * r.randrange(2, 7) + w[s + p :]
        found = periodic_runs.runs(w)
        n_runs += len(found)
        assert found == brute_runs(w)
    assert n_runs > 1000
    assert periodic_runs.runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    many = [b"%d" % i for i in range(20_000)]
    assert periodic_runs.runs(many * 5) == [(0, 100_000, 20_000)] and periodic_runs.runs(many * 3) == []


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w) if len(set(w)) < len(w) else []
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t).hexdigest()
    return (doc_id, len(found), s, n, q, 1000 * n // q if q else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query_against_brute_force(spark, tmp_path):
    texts = [(r.doc_id, r.text) for r in shared.table(spark, SMALL, "documents").collect() if len(r.text or "") < 12_000]
    texts += [(i, t if len(t or "") < 12_000 else t[:12_000]) for i, t, _ in odd_rows()] + [(i, " ".join(prose(i, 9).split() * 9)) for i in range(500, 540)] + [(7, "a b \x0ba b\x1fc " * 9)]
    frame(spark, [(i, t, "s") for i, t in texts]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = periodic_runs.op13_periodic_runs(spark, f"file://{tmp_path}")
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, rows.collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in texts), key=str)
    assert sum(r[1] > 0 for r in got) > 40


def test_run_operator_keeps_real_texts(spark, none):
    rows = periodic_runs.detect(frame(spark, [(1, "x " + "go on " * 5 + "end", "s"), (2, None, "s")])).orderBy("doc_id").collect()
    assert rows[0].text == "x go on end" and [tuple(r) for r in rows[0].runs] == [(1, 10, 2)] and (rows[1].text, rows[1].runs) == ("", [])
    assert periodic_runs.detect(none).count() == 0


def test_run_detection_needs_no_shuffle(odd):
    assert "Exchange" not in periodic_runs.detect(odd)._jdf.queryExecution().executedPlan().toString()


def test_cluster_sql_over_more_vectors(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.1/embeddings.parquet')")
    df = centroids.op12_block_norm_centroids(spark, "/root/testdata/sf0.1")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({centroids.OP12_SQL})").fetchall())
    assert df.agg(F.count("*")).first()[0] > 1000
