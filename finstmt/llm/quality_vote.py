"""Quality by nearest-neighbour voting in a latent-semantic space.

Tokens and their shapes are hashed to term counts, weighted by log counts and inverse document frequencies
(counted over all documents), and projected to ``RANK`` dimensions by a truncated singular value
decomposition of the labelled sample. The sample's vectors are broadcast (about ``MOST`` x ``RANK`` floats);
every document is held against all of them by exact cosine products, a block at a time, and its ``NEAREST``
neighbours vote with their similarity as weight.

Cases
- null or empty text: no terms, no similarity; the score is the mean label of the sample.
- very long texts are read whole. No labels: every score is 0.5. Equal similarities: the sample's earlier row (by id) first.
- repeated rows: each row is scored alone. A null doc_id is not held out. Extra columns are ignored.
- empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, shared

FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
TERMS, RANK, MOST, NEAREST, SHARPNESS = 4096, 48, 4096, 25, 4
BLOCK = 256
AGAIN, VARIETY = 0, 1  # terms: a token that repeats the one before it; ten steps of distinct tokens' share
FIRST = VARIETY + 11
_SHAPE = [(re.compile(rb"[A-Z\xc3]+[\x80-\x9f\x99A-Z]*"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"9")]


def shape(token: bytes) -> bytes:
    """Runs of upper case, lower case and digits as one sign each; other characters stay."""
    for pattern, sign in _SHAPE:
        token = pattern.sub(sign, token)
    return token[:24]


#: A byte that stands for all that shape() treats alike: upper case, lower case, what may be either, digits; \xc3 stays.
_ALIKE = bytes(65 if 65 <= c <= 90 else c if c == 0xC3 else 0x80 if 0x80 <= c <= 0x9F else 97 if 97 <= c <= 122 or c >= 0xA0 else 57 if 48 <= c <= 57 else c for c in range(256))


class _Terms(dict):
    """(word term, shape term) of a token, remembered up to a bound; so are shapes, which many tokens share."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, token: bytes) -> tuple[int, int]:
        if len(self) > shared.REMEMBERED:
            self.clear()
        half = TERMS // 2
        alike = token.translate(_ALIKE)
        of_shape = self.shapes.get(alike)
        if of_shape is None:
            if len(self.shapes) > shared.REMEMBERED:
                self.shapes.clear()
            of_shape = self.shapes[alike] = half + xxhash.xxh32_intdigest(shape(token)) % half
        t = self[token] = (FIRST + xxhash.xxh32_intdigest(token.translate(shared.LOWER)) % (half - FIRST), of_shape)
        return t


def counted(texts: list[str | None], terms: _Terms) -> np.ndarray:
    """Term counts, a row for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        ws = text.encode().split() if text else []
        if ws:
            both = np.fromiter(chain.from_iterable(map(terms.__getitem__, ws)), np.int64, 2 * len(ws))
            row += np.bincount(both, minlength=TERMS)
            row[AGAIN] = sum(map(bytes.__eq__, ws, ws[1:]))
            row[VARIETY + 10 * len(set(ws)) // len(ws)] = len(ws)
    return out


def present(text: str | None, terms: _Terms) -> np.ndarray:
    """The terms that counted() gives a text, each once: only its distinct tokens are looked up."""
    ws = text.encode().split() if text else []
    if not ws:
        return np.zeros(0, np.int64)
    distinct = set(ws)
    there = set(chain.from_iterable(map(terms.__getitem__, distinct)))
    there.add(VARIETY + 10 * len(distinct) // len(ws))
    if len(distinct) < len(ws) and any(map(bytes.__eq__, ws, ws[1:])):
        there.add(AGAIN)
    return np.fromiter(there, np.int64, len(there))


def _blocks(b: pa.RecordBatch, terms: _Terms) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(0, b.num_rows, BLOCK):
        yield i, counted(b.column("text").slice(i, BLOCK).to_pylist(), terms)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, df, n = _Terms(), np.zeros(TERMS, np.int64), 0
    for b in batches:
        for text in b.column("text"):
            df[present(text.as_py(), terms)] += 1
        n += b.num_rows
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int64()), pa.array([n, *df[there]], pa.int64())], ["term", "n"])


def idf(docs: DataFrame) -> np.ndarray:
    """Over all documents; a row for each term reaches the driver."""
    rows = shared.in_batches(docs.select("text"), _frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r.term: r.n for r in rows}
    seen = np.array([df.get(t, 0) for t in range(TERMS)], float)
    return np.log((1 + df.get(-1, 0)) / (1 + seen)).astype(np.float32) + np.float32(0.1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def weighted(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * by)


class Neighbours:
    def __init__(self, by: np.ndarray, basis: np.ndarray, vectors: np.ndarray, y: np.ndarray):
        self.by, self.basis, self.vectors, self.y = by, basis, vectors, y

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(counts), 0.5)
        near = _unit(weighted(counts, self.by) @ self.basis) @ self.vectors.T
        k = min(NEAREST, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(float) ** SHARPNESS
        total = sim.sum(axis=1)
        return np.clip(np.where(total > 1e-9, (sim * self.y[at]).sum(axis=1) / np.maximum(total, 1e-9), self.y.mean()), 0, 1)


def fit(counts: np.ndarray, y: np.ndarray, by: np.ndarray, rank: int = RANK) -> Neighbours:
    """Truncated SVD by a randomised range finder with power iterations; counts: a row of terms for each label."""
    x = weighted(counts, by)
    q = np.random.default_rng(10).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    basis = q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T if len(x) else q[:, :rank]
    return Neighbours(by, basis.astype(np.float32), _unit(x @ basis).astype(np.float32), y.astype(float))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = _Terms()
    for b in batches:
        rows = [x for _, block in _blocks(b, terms) for x in block]
        at = [np.flatnonzero(x) for x in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(rows, at, strict=True)], pa.list_(pa.float32())), b.column("y")], ["doc_id", "at", "n", "y"]
        )


def learn(documents: DataFrame, labels: DataFrame, most: int = MOST) -> Neighbours:
    """Of the sample, term counts reach the driver (a row of TERMS for each labelled id), texts do not."""
    sample = shared.in_batches(labelled.sample(documents, labels, "quality", FOLDS, FOLD, most), _sparse, "doc_id bigint, at array<int>, n array<float>, y int")
    found = sample.toArrow().sort_by("doc_id")
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    for row, at, n in zip(counts, found.column("at"), found.column("n"), strict=True):
        row[at.values.to_numpy()] = n.values.to_numpy()
    return fit(counts, found.column("y").to_numpy(), idf(documents))


def _vote(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = model.value, _Terms()
        for b in batches:
            score = np.concatenate([np.zeros(0), *(m.scores(x) for _, x in _blocks(b, terms))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Neighbours) -> DataFrame:
    return shared.in_batches(docs, _vote(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, score double")


def op10_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shared.table(spark, sf_dir, "documents")
    model = learn(documents, shared.table(spark, sf_dir, "labels"))
    found = scored(shared.pick(documents, doc_id="bigint", text="string"), model)
    return found.select("doc_id", labelled.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
