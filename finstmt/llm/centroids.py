"""Centroid clustering in integers, screened by block norms.

A vector's compressed form is the norm of each of its segments. By Cauchy and Schwarz, segment by segment, the product
of a vector and a centroid is at most the product of their compressed forms, so |x|^2 + |c|^2 - 2 x'c' bounds their
squared distance from below. All bounds of a batch are one small matrix product; the centroid of the smallest bound
gets the first exact distance, and of the others only those whose bound does not exceed the best distance so far get
one, in 64-bit integers. Compressed forms of vectors are computed once, those of centroids once a round.

A round is one pass over the settled vectors: each task sums its vectors by cluster, and the sums of tasks are added
by cluster and component, so the driver sees one row for each of them, however many vectors there are.

Cases
- kept are vectors of exactly ``dims`` components, none null or non-finite, whose integers are within +-2**27 (so that
  a squared distance fits a long); others, and null vectors, have no row.
- null vec_id: has no hash, so starts no centroid; it is assigned and counted as any other.
- repeated rows: each counts. Equal hashes (a repeated vec_id) are ordered by their components.
- a tie of distances goes to the smaller number. An empty cluster keeps its centroid. Fewer vectors than centroids:
  as many centroids as vectors that have a vec_id; if none has, the zero vector.
- sums of distances beyond a long: null.
- empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components of a segment.
SEGMENT = 8
LARGEST = 1 << 27


def norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The compressed form: a norm for each segment of each row."""
    return np.sqrt(np.add.reduceat(np.square(x, dtype=np.float64), range(0, x.shape[1], segment), axis=1))


def _integers(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), dims), False))
            x = pc.fill_null(b.column("embedding").flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                keep = (np.abs(x) <= LARGEST).all(axis=1)
            x = x[keep].astype(np.int32)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(t)) for v, t in ((x, pa.int32()), (norms(x), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(keep)), *lists], ["vec_id", "v", "norms"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def nearest(x: np.ndarray, compressed: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, exact distances computed) of each row of x."""
    c = norms(centroids, segment)
    size = np.square(compressed).sum(axis=1)[:, None] + np.square(c).sum(axis=1)
    bound = size - 2 * (compressed @ c.T) - (1e-9 * size + 1)  # less than rounding can have added
    label = bound.argmin(axis=1)
    first = label.copy()

    def distance(rows, to) -> np.ndarray:
        d = x[rows].astype(np.int64) - to
        return np.einsum("ij,ij->i", d, d)

    best, n = distance(slice(None), centroids[label]), np.ones(len(x), np.int64)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
        if len(rows):
            n[rows] += 1
            d = distance(rows, centroids[j])
            better = (d < best[rows]) | ((d == best[rows]) & (j < label[rows]))
            best[rows[better]], label[rows[better]] = d[better], j
    return label, best, n


def _labelled(centroids: np.ndarray):
    width = -(-centroids.shape[1] // SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), centroids.shape[1])
                yield b, x, nearest(x, _matrix(b.column("norms"), width), centroids)

    return run


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x, (label, _, _) in _labelled(centroids)(batches):
            order = np.argsort(label, kind="stable")
            there, begin = np.unique(label[order], return_index=True)
            total[there] += np.add.reduceat(x[order].astype(np.int64), begin, axis=0)
            count += np.bincount(label, minlength=len(count))
        used = np.flatnonzero(count)
        columns = [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' floor of the mean; one without vectors stays."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = shared.in_batches(vectors, _sums(centroids), "cluster int, n bigint, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("i", "total"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(exact("n"), exact("total")).collect():  # a row for each component of a centroid
        out[r.cluster, r.i] = int(r.total) // int(r.n)
    return out


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, found in _labelled(centroids)(batches):
            label, best, n = found
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(best), pa.array(n)], ["vec_id", "cluster", "distance", "n_exact"])

    return run


@shared.sized
def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, n_exact: exact distances that the screen left, of every kept vector; the centroids)."""
    raw = shared.pick(embeddings, vec_id="bigint", embedding="array<double>")
    vectors = shared.settle(shared.in_batches(raw, _integers(dims, scale), "vec_id bigint, v array<int>, norms array<double>"), "vectors")
    ranked = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    start = [r.v for r in ranked.orderBy("h", "v").limit(k).collect()]
    centroids = np.array(start or [[0] * dims], np.int64)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = shared.settle(shared.in_batches(vectors, _assigned(centroids), "vec_id bigint, cluster int, distance bigint, n_exact bigint"), "clusters")
    shared.discard(vectors)
    return found, centroids


def op12_block_norm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(shared.table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each cluster
    long = lambda n: n if n < 1 << 63 else None
    rows = [(j, long(d), long(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """The chain of assignments a0, a1, ... and centroids c1, c2, ... between them."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT rid, c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k CROSS JOIN c{r} m),
a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT a.c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM a{r} a JOIN kept k USING (rid)),
s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM u{r} GROUP BY c, i),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.v, m.v) AS v FROM c{r} m LEFT JOIN n{r} n USING (c))""")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH finite AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
kept AS MATERIALIZED (
  SELECT rid, vec_id, list_transform(f, lambda x: x::BIGINT) AS v FROM finite WHERE len(list_filter(f, lambda x: abs(x) <= 134217728)) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 40),
{_rounds_sql(ROUNDS)}
SELECT k.vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept k USING (rid) JOIN c{ROUNDS} m USING (c)
"""
