"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word stems (present, twice, three times) is trained in numpy from confirmed toxic examples and
unlabelled text. With class prior p, the risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives));
where the difference falls below zero its gradient is reversed (Kiryo et al. 2017). Steps are proximal
AdaGrad with an L1 penalty, which leaves the few words that tell.

No label but "toxic" is read. The class prior, where it is not given, is estimated from the scores of parts that
the weights have not seen: the least ratio of the unlabelled share to the positives' share above a score, with
its margin of error (Garg et al. 2021). The slope of the score minimises the same
risk on those parts, and its mean over unlabelled text is the prior.

Training takes about ``MOST_POSITIVE`` toxic documents outside the held-out fold, and as unlabelled text about
``MOST_UNLABELLED`` of all documents outside it.

Cases
- null or empty text: the score of a document without words.
- no positives at all, or no other text: every score is 0, nothing is predicted toxic.
- repeated rows and ties: each row is scored alone; in the unlabelled set equal rows count once.
- very long texts are read whole. A null doc_id is not held out. Extra columns are ignored.
- empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, shared

FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
BITS = 20
STEMS = (4, 5, 6, 7)
LEVELS = 3
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 8_192, 16_384, 4_096
PARTS, FIRST_PRIOR = 4, 0.2


def stems(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and its longer beginnings."""
    text = word.decode()
    parts = [b"=" + word, *(b"^" + text[:k].encode() for k in STEMS if len(text) > k)]
    return tuple(xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in parts)


class _Stems(dict):
    """Stems of words (those in ``wanted``, if given), remembered up to a bound."""

    def __init__(self, wanted: set[int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > shared.REMEMBERED:
            self.clear()
        t = self[word] = tuple(x for x in stems(word) if self.wanted is None or x in self.wanted)
        return t


def features(text: str | None, known: _Stems) -> list[int]:
    """Sorted ``stem * 4 + level`` for each stem and each level (1 to LEVELS) that its count reaches."""
    counts = Counter(chain.from_iterable(map(known.__getitem__, shared.alnum_words(text))))
    return sorted(s * 4 + k for s, c in counts.items() for k in range(1, min(c, LEVELS) + 1))


class Rows:
    """Sparse 0/1 rows: feature numbers end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.size = len(rows), np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        self.of = np.repeat(np.arange(self.n), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, g[self.of], width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the risk by the scores of positives and of unlabelled text; where the estimated risk of negatives falls
    below zero, the gradient that brings it back."""
    gu, gp_minus, gp_plus = _sigmoid(zu) / len(zu), -prior * _sigmoid(zp) / len(zp), -prior * _sigmoid(-zp) / len(zp)
    if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
        return gp_plus + gp_minus, gu
    return -gp_minus, -gu


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, width: int, steps: int = 150, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and offset of the non-negative risk estimator with logistic loss, the mean of the second half of the steps."""
    p, u = Rows(positives), Rows(unlabelled)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    squares, b_square = np.full(width, 1e-8), 1e-8
    l1 = prior * np.sqrt(0.05 / p.n)
    mean_w, mean_b, counted = np.zeros(width), 0.0, steps - steps // 2
    for k in range(steps):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        on_p, on_u = gradient(zp, zu, prior)
        g, gb = p.back(on_p, width) + u.back(on_u, width), on_p.sum() + on_u.sum()
        squares += g * g
        b_square += gb * gb
        step = rate / np.sqrt(squares)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * gb / np.sqrt(b_square)
        if k >= steps // 2:
            mean_w, mean_b = mean_w + w / counted, mean_b + b / counted
    return mean_w, mean_b


def scale(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic score, from scores of positives and unlabelled text alone.

    The slope is that of the least non-negative risk over a grid of slopes and middles; the offset then makes the
    mean score of unlabelled text the prior.
    """
    soft, best = lambda x: np.logaddexp(0, x), (np.inf, 1.0)
    middles = np.unique(np.quantile(np.concatenate([zp, zu]), np.linspace(0, 1, 65)))
    for a in 0.25 * 2 ** np.arange(0, 6.5, 0.5):
        for m in middles:
            xp, xu = a * (zp - m), a * (zu - m)
            best = min(best, (prior * soft(-xp).mean() + max(0.0, soft(xu).mean() - prior * soft(xp).mean()), a))
    a = float(best[1])
    low, high = -100.0 * a, 100.0 * a
    for _ in range(80):
        b = (low + high) / 2
        low, high = (low, b) if _sigmoid(a * zu + b).mean() > prior else (b, high)
    return a, b


def prior_of(zp: np.ndarray, zu: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives in the unlabelled text, from scores that training has not seen.

    Above any score the unlabelled text holds at least prior times the positives' share; the ratio is taken
    where it is least with both shares' margins of error (Dvoretzky, Kiefer and Wolfowitz) at ``doubt``.
    """
    at = np.unique(zp)
    above = lambda z: 1 - np.searchsorted(np.sort(z), at, "left") / len(z)
    p, u = above(zp), above(zu)
    margin = sum(np.sqrt(np.log(4 / doubt) / (2 * len(z))) for z in (zp, zu))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 1 / (len(zu) + 1), 0.95))


class Model:
    def __init__(self, weights: dict[int, float], offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift
        self.wanted = {f // 4 for f in weights}

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (sums + self.offset) + self.shift)


NEVER = Model({}, 0.0, 0.0, -50.0)


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], part_p: np.ndarray, part_u: np.ndarray, prior: float | None = None) -> Model:
    """Train on all rows; prior and scale come from parts that were left out in turn (a document's rows are of one part)."""
    if not positives or not unlabelled:
        return NEVER
    every = [*positives, *unlabelled]
    used, at = np.unique(np.concatenate([*every, np.zeros(0, np.int64)]), return_inverse=True)
    split = np.split(at, np.cumsum([len(r) for r in every])[:-1])
    p, u = split[: len(positives)], split[len(positives) :]
    zp, zu, given = np.zeros(len(p)), np.zeros(len(u)), prior
    for prior in (given or FIRST_PRIOR, given):
        prior = prior or prior_of(zp, zu)
        for k in range(PARTS):
            on_p, on_u = [r for r, i in zip(p, part_p, strict=True) if i != k], [r for r, i in zip(u, part_u, strict=True) if i != k]
            if on_p and on_u:
                w, b = train(on_p, on_u, prior, len(used))
                for z, rows, part in ((zp, p, part_p), (zu, u, part_u)):
                    out = np.flatnonzero(part == k)
                    z[out] = Rows([rows[i] for i in out]).dot(w) + b
    prior = given or prior_of(zp, zu)
    slope, shift = scale(zp, zu, prior)
    w, b = train(p, u, prior, len(used))
    keep = np.flatnonzero(w)
    return Model(dict(zip(used[keep].tolist(), w[keep].tolist(), strict=True)), b, slope, shift)


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, among, positive = _Stems(), Counter(), Counter()
    for b in batches:
        for text, y in zip(b.column("text"), b.column("positive").to_pylist(), strict=True):
            (positive if y else among).update(features(text.as_py(), known))
    names = [*among, *(f for f in positive if f not in among)]
    columns = [names, [among[f] for f in names], [positive[f] for f in names]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["feature", "n", "k"])


def selected(sample: DataFrame, most: int = MOST_FEATURES) -> list[int]:
    """The features whose share among the positives differs most from their share in unlabelled text, in deviations."""
    size = sample.agg(F.count_if(~F.col("positive")).alias("n"), F.count_if("positive").alias("p")).first()
    if not size.p or not size.n:
        return []
    counts = shared.in_batches(sample, _support, "feature bigint, n bigint, k bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    share = F.least((F.col("n") + 0.5) / (size.n + 1), F.lit(0.9999))
    z = (F.col("k") / size.p - share) / F.sqrt(share * (1 - share) / size.p)
    strong = counts.where("k >= 3 or n >= 50").select("feature", F.abs(z).alias("z")).where("z > 2")
    return sorted(r.feature for r in strong.orderBy(F.desc("z"), "feature").limit(most).collect())


def _reduced(chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(chosen.value)
        known = _Stems({f // 4 for f in wanted})
        for b in batches:
            rows = [[f for f in features(t.as_py(), known) if f in wanted] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("part"), pa.array(rows, pa.list_(pa.int64())), b.column("positive")], ["h", "part", "at", "positive"])

    return run


@shared.sized
def learn(documents: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = MOST_POSITIVE, unlabelled: int = MOST_UNLABELLED) -> Model:
    """The model of the toxic documents outside the held-out fold and of unlabelled text.

    Of the sample, the chosen features' numbers reach the driver (MOST_FEATURES a row at most), texts do not.
    """
    toxic = labelled.sample(documents, labels, "toxic", FOLDS, FOLD, positives, only=1).select("doc_id", "text", F.lit(True).alias("positive"))
    rest = labelled.unlabelled(documents, FOLDS, FOLD, unlabelled).select("doc_id", "text", F.lit(False).alias("positive"))
    number = toxic.unionByName(rest).withColumn("h", F.xxhash64("doc_id", "text")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    sample = shared.settle(number, "toxic-sample")
    chosen = documents.sparkSession.sparkContext.broadcast(selected(sample))
    table = shared.in_batches(sample, _reduced(chosen), "h bigint, part int, at array<bigint>, positive boolean").toArrow().sort_by([("h", "ascending")])
    is_p, part = (table.column(c).to_numpy() for c in ("positive", "part"))
    rows = [np.array(x.as_py(), np.int64) for x in table.column("at")]
    pick = lambda which: [r for r, w in zip(rows, which, strict=True) if w]
    shared.discard(sample)
    return fit(pick(is_p), pick(~is_p), part[is_p], part[~is_p], prior)


def _score(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        known = _Stems(m.wanted)
        for b in batches:
            sums = np.array([sum(m.weights.get(f, 0.0) for f in features(t.as_py(), known)) for t in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(m.scores(sums), pa.float64())], [*keep, "score"])

    return run


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs (which has ``text``) and a score between 0 and 1."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return shared.in_batches(docs, _score(docs.sparkSession.sparkContext.broadcast(model), keep), schema)


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents that score below the threshold, columns as they were."""
    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return scored(rows, learn(documents, labels), ["row"]).where(F.col("score") < threshold).select("row.*")


def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shared.table(spark, sf_dir, "documents")
    model = learn(documents, shared.table(spark, sf_dir, "labels"))
    found = scored(shared.pick(documents, doc_id="bigint", text="string"), model, ["doc_id"])
    return found.select("doc_id", labelled.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
