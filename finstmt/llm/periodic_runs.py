"""Runs of words that repeat with a period.

A run is a stretch of words with smallest period q (words q apart are identical), at least max(6, 4q) long, that cannot
be extended. They are found by block matching, scale by scale: for periods from B to 2B - 1, B a power of two, the
text's aligned blocks of B words are the keys of one automaton over the words' numbers, and the text is searched for
all of them at once. A run of at least four periods holds two or more neighbouring aligned blocks, each with an
occurrence one period behind it. As all keys are of one length, a place of the text is an occurrence of one key at
most, and of the aligned blocks only one lies B to 2B - 1 words before it: so there are no more seeds than words, and
neighbouring seeds of one distance are joined before they are extended, word for word, to both sides.

What is searched: three neighbouring words of a run stand a period or less from the same three words. Only stretches of
such places, long enough for the scale, are cut into blocks and searched; this loses no run, and prose without runs
has none. Stretches that lie in one run of a smaller period hold no further runs of their own and are skipped.

Documents are independent: no row moves between tasks. Time is n log n in the words of a text, memory in proportion.

Cases
- null, empty or white text: no words, no runs, collapsed to the empty text.
- null doc_id: nothing is repeated in its words (it has no checksum); otherwise as any other.
- repeated rows and ties: each row has its own result; of runs of equal length the first, then the smallest period.
- very long texts: whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

MIN_LENGTH, MIN_PERIODS = 6, 4

Run = tuple[int, int, int]


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _gaps(u: np.ndarray) -> np.ndarray:
    """Of each place, how far the nearest other occurrence of its three words is (none: more than the text has words)."""
    n = len(u)
    gap = np.full(n - 2, n, np.int64)
    base = int(u.max()) + 1
    pair = u[:-1] * base + u[1:]
    if base >= 1 << 20:  # three numbers would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * base + u[2:]
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    left, right = order[same], order[same + 1]
    gap[right] = right - left
    gap[left] = np.minimum(gap[left], right - left)
    return gap


def _stretches(live: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[begin, end) of the words of each stretch of live places that is ``least`` words or longer."""
    edges = np.flatnonzero(np.diff(live.astype(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2] + 2
    keep = end - begin >= least
    return list(zip(begin[keep].tolist(), end[keep].tolist(), strict=True))


def _seeds(u: np.ndarray, stretches: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the aligned block, distance) of every occurrence of a block ``size`` to 2 * size - 1 words behind it."""
    keys, key_of, texts = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, []
    for begin, end in stretches:
        text = tuple(u[begin:end].tolist())
        texts.append(text)
        for j in range(-(-begin // size), end // size):
            block = text[j * size - begin : (j + 1) * size - begin]
            key_of[j] = keys.get(block, j)  # equal blocks share the number of the first
            keys.add_word(block, key_of[j])
    keys.make_automaton()
    found = []
    for (begin, _), text in zip(stretches, texts, strict=True):
        for last, key in keys.iter(text):
            at = begin + last + 1 - size
            j = at // size - 1
            if key_of.get(j) == key:
                found.append((j, at - j * size))
    block, distance = np.array(found, np.int64).reshape(-1, 2).T
    return block, distance


def _chains(block: np.ndarray, distance: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, distance): stretches that neighbouring seeds of one distance prove, if a run can have grown from them."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    first = np.flatnonzero((np.diff(distance, prepend=-1) != 0) | (np.diff(block, prepend=-2) != 1))
    n, q = np.diff(first, append=len(block)), distance[first]
    # Less than a block can be added at each end.
    keep = (n + 2) * size + q - 2 >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
    begin = block[first] * size
    yield from zip(begin[keep].tolist(), (begin + n * size + q)[keep].tolist(), q[keep].tolist(), strict=True)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements agree."""
    step, done = 64, 0
    n = min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done : min(done + step, n)] != b[done : min(done + step, n)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return n


def _extended(u: np.ndarray, begin: int, end: int, q: int) -> tuple[int, int]:
    """The stretch of period q as far as it goes to both sides."""
    end += _same(u[end:], u[end - q :])
    begin -= _same(u[:begin][::-1], u[: begin + q][::-1])
    return begin, end


def _smaller_period(root: np.ndarray) -> bool:
    """Whether the words of one period repeat with a smaller one, which divides it."""
    n, rest, p = len(root), len(root), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if (root[n // p :] == root[: n - n // p]).all():
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def runs(words: list[bytes]) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < MIN_LENGTH:
        return []
    u = _numbers(words)
    gap = _gaps(u)
    found: set[Run] = set()
    size = 1
    while MIN_PERIODS * size <= n:
        stretches = _stretches(gap < 2 * size, max(MIN_LENGTH, MIN_PERIODS * size))
        if found and stretches:
            starts, ends = np.array(sorted((s, s + length) for s, length, _ in found)).T
            ends = np.append(0, np.maximum.accumulate(ends))
            inside = ends[np.searchsorted(starts, [b for b, _ in stretches], "right")]
            stretches = [x for x, e in zip(stretches, inside.tolist(), strict=True) if x[1] > e]
        if stretches:
            for begin, end, q in _chains(*_seeds(u, stretches, size), size):
                begin, end = _extended(u, begin, end, q)
                if end - begin >= max(MIN_LENGTH, MIN_PERIODS * q) and not _smaller_period(u[begin : begin + q]):
                    found.add((begin, end - begin, q))
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, q in found:
        kept[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of every tenth document by checksum, the words from some place on repeat what follows that place."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


SCHEMA = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"


def _by_document(prepare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            all_runs, texts = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                words = prepare(words, doc_id) if prepare else words
                found = runs(words)
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(all_runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    return run


def detect(documents: DataFrame, prepare=None) -> DataFrame:
    """doc_id, runs and text, the words without repeats joined by one space, of every document; ``prepare(words,
    doc_id)`` may change the words before."""
    return shared.in_batches(shared.pick(documents, doc_id="bigint", text="string"), _by_document(prepare), SCHEMA)


DIGEST = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    schema = pa.schema([(c, pa.string() if c.endswith("256") else pa.int64()) for c in names])
    sha = lambda s: hashlib.sha256(s).hexdigest()
    for b in batches:
        rows = []
        for doc_id, found, text in zip(b.column("doc_id").to_pylist(), b.column("runs").to_pylist(), b.column("text"), strict=True):
            found = [(r["start"], r["length"], r["period"]) for r in found]
            start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            rows.append((doc_id, len(found), start, length, q, 1000 * length // q if q else None, sha(listed.encode()), sha(text.as_py().encode())))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.in_batches(detect(shared.table(spark, sf_dir, "documents"), repeated), _digests, DIGEST)
