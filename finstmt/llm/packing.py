"""Packing along a space-filling curve.

A document's hashed token vector is projected to DIMS dimensions, its cell on a grid becomes a Hilbert key,
and all documents are sorted by range along the curve. Neighbours on the curve are laid end to end and cut
every ``length`` ids, so only the very last sequence is padded. The range sort moves keys and lengths only;
token ids are written once and joined to their places.

Cases
- null or empty text: the end id alone, one piece of one id.
- equal keys (copies, ties, repeated rows): ordered by row number, so one key may span partitions.
- a document longer than a sequence: several pieces, however long it is. A null doc_id keeps its pieces.
- empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

LENGTH = 1024
END_ID = 0
DIMS, BITS = 4, 10
#: Documents of one range of the curve at most, about; smaller tables have a range for each shuffle partition.
RANGE = 1_000_000


def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(4).standard_normal((1 << 16, dims), np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows; each coordinate of ``bits`` bits).

    Skilling's transform (2004): undo the excess rotations from the highest bit down, Gray-encode across the
    axes, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _encode(dims: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = _directions(dims)
        for b in batches:
            packs, n, at = [], [], []
            for text in b.column("text"):
                v = tokens.packed(tokens.ids(text.as_py()), end)
                packs.append(v.tobytes())
                n.append(len(v))
                at.append(to[v].mean(axis=0))
            where = pa.array([x.tolist() for x in at], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packs, pa.binary()), pa.array(n, pa.int64()), where], ["doc_id", "ids", "n", "place"])

    return run


def encoded(docs: DataFrame, dims: int = DIMS, end: int = END_ID) -> DataFrame:
    """One row for each document: doc_id, ids (two bytes each), n, place (the projected vector)."""
    return shared.in_batches(docs, _encode(dims, end), "doc_id bigint, ids binary, n bigint, place array<double>")


def with_key(docs: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """rid, n and the Hilbert key. The grid spans three deviations around the mean of all documents."""
    stats = docs.agg(*(f(F.get("place", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.avg, F.stddev_pop))).first()
    middle = np.array([stats[f"avg{i}"] or 0.0 for i in range(dims)])
    spread = np.array([stats[f"stddev_pop{i}"] or 1.0 for i in range(dims)])

    @F.pandas_udf("bigint")
    def key(place: pd.Series) -> pd.Series:
        z = (np.stack(place.to_numpy()) - middle) / spread / 6 + 0.5 if len(place) else np.zeros((0, dims))
        return pd.Series(hilbert_key(np.clip(z * (1 << bits), 0, (1 << bits) - 1), bits))

    return docs.select("rid", "n", key("place").alias("key"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums from the begin of each range. One task may hold several ranges, one after the other."""
    now, total = None, 0
    for b in batches:
        n, part = b.column("n").to_numpy(), b.column("part").to_numpy()
        before = np.cumsum(n) - n
        first = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))  # where a range begins in this batch
        base = before[first]
        if len(first) and part[0] == now:
            base[0] -= total
        start = before - np.repeat(base, np.diff(first, append=len(n)))
        if len(n):
            now, total = part[-1], int(start[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("part"), pa.array(start, pa.int64()), b.column("n")], ["rid", "part", "start", "n"])


def places(keyed: DataFrame) -> DataFrame:
    """(rid, place): where each document begins when all are laid end to end along the curve."""
    spark = keyed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // RANGE))
    # A range's number is taken from its own partition: the task may have gathered several of them.
    order = keyed.repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid").withColumn("part", F.spark_partition_id())
    order = shared.settle(shared.in_batches(order, _running, "rid bigint, part int, start bigint, n bigint"), "pack-order")
    totals = order.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each range
    before = np.cumsum([0, *(r.n for r in totals)]).tolist()
    offsets = spark.createDataFrame([(r.part, b) for r, b in zip(totals, before, strict=False)], "part int, before bigint")
    return order.join(F.broadcast(offsets), "part").select("rid", (F.col("before") + F.col("start")).alias("place"))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, raw, place in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("place").to_pylist(), strict=True):
                v = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                at = 0
                while at < len(v):
                    sequence, offset = divmod(place + at, length)
                    size = min(length - offset, len(v) - at)
                    out.append((doc, at, size, zlib.crc32(v[at : at + size].tobytes()), len(v), sequence, offset))
                    at += size
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE)

    return run


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@shared.sized
def pack(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document."""
    docs = shared.pick(documents, doc_id="bigint", text="string")
    docs = shared.settle(encoded(docs).withColumn("rid", F.monotonically_increasing_id()), "pack-ids")
    where = places(with_key(docs))
    placed = docs.select("rid", "doc_id", "ids").join(where, "rid").select("doc_id", "ids", "place")
    return shared.in_batches(placed, _cut(length), ", ".join(f"{c} bigint" for c in PIECE))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
