"""Benchmark decontamination with an FM-index for each shard of training text.

Windows of ``size`` consecutive words of the benchmark items (an item of fewer words is one window) are
searched in every document. Each batch of documents becomes a sequence of word numbers, all of whose words are
indexed in shards of ``SHARD`` symbols (with the reach of a window more, so none is missed where shards meet).
A shard gets a suffix array, its Burrows-Wheeler transform as a wavelet matrix, and sampled suffix positions;
all windows are searched backwards at once, occurrences are located by walking to a sampled position, and the
spans found are merged. Words that are in no window, which no search can ask for, are indexed in their places
under ``OTHERS`` symbols in turn.

The windows are dealt into blocks of bounded bytes; one block at a time is sent to the tasks, so the
benchmark may grow. A usual benchmark is one block.

Cases
- null text or no words: n_words 0, nothing hit. An item without words (or null) has no window.
- items that share an id count once, a null item_id counts as ''.
- repeated rows: each row has its own result. Extra columns are kept or dropped as ``keep`` says.
- very long texts are indexed whole, in as many shards as they take.
- empty documents: no rows; empty benchmark: nothing is hit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SIZE = 10
BLOCK_BYTES = 32 << 20
SHARD = 1 << 18
SAMPLE = 16
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words as they stand in a text that is not lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, GAP, FIRST = 0, 1, 2  # symbols: end of a shard, end of a text, the first word of a window
OTHERS = 1 << 8  # symbols of words that are in no window
SPANS = "array<struct<first:bigint,last:bigint>>"


class WaveletMatrix:
    """Rank over a sequence of small integers, a bit plane a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels, seq = [], seq.astype(np.int32)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            zero = (seq & (1 << bit)) == 0
            zeros_before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(zero, out=zeros_before[1:])
            self.levels.append((bit, zeros_before))
            seq = np.concatenate([seq[zero], seq[~zero]])

    def rank(self, symbol: np.ndarray, *upto: np.ndarray) -> list[np.ndarray]:
        """How often symbol[k] stands before position x[k], for each x of upto."""
        places = [np.zeros_like(upto[0]), *upto]
        for bit, zeros in self.levels:
            one, n_zeros = ((symbol >> bit) & 1).astype(bool), zeros[-1]
            before = [zeros[x] for x in places]
            places = [np.where(one, n_zeros + x - z, z) for x, z in zip(places, before, strict=True)]
        return [x - places[0] for x in places[1:]]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bit, zeros in self.levels:
            one = zeros[at + 1] == zeros[at]
            symbol |= one.astype(at.dtype) << bit
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return symbol


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling of those suffixes that are not told apart yet; s ends with its only END."""
    order = np.argsort(s, kind="stable")
    rank = np.zeros(len(s), np.int64)
    at, first, k = np.arange(len(s)), s[order], 1  # places in order, and what is equal within a group
    while len(at):
        new = np.concatenate([[True], first[1:] != first[:-1]])
        rank[order[at]] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.concatenate([new[1:], [True]])
        at = at[~alone]
        suffix = order[at]
        key = rank[suffix] * (len(s) + 1) + rank[np.minimum(suffix + k, len(s) - 1)]
        by = np.argsort(key, kind="stable")
        order[at], first, k = suffix[by], key[by], 2 * k
    return order


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        sa = suffix_array(s)
        bwt = s[sa - 1].astype(np.int64)
        self.n, self.wavelet = len(s), WaveletMatrix(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, lo, hi) of the patterns that occur. Patterns are right-aligned rows of at least one symbol."""
        width, last = patterns.shape[1], patterns[:, -1]
        lo, hi = self.before[last], self.before[last + 1]
        alive = np.flatnonzero(lo < hi)
        lo, hi, done = lo[alive], hi[alive], []
        for step in range(1, width + 1):
            over = lengths[alive] == step
            if over.any():
                done.append((alive[over], lo[over], hi[over]))
                alive, lo, hi = alive[~over], lo[~over], hi[~over]
            if not len(alive):
                break
            c = patterns[alive, width - 1 - step]
            lo, hi = (self.before[c] + x for x in self.wavelet.rank(c, lo, hi))
            there = lo < hi
            alive, lo, hi = alive[there], lo[there], hi[there]
        done.append((alive[:0], lo[:0], hi[:0]))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))  # type: ignore[return-value]

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into lo, text position) of every occurrence."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        at, steps, todo = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            hit = self.sampled[row]
            at[todo[hit]] = self.samples[self.sample_rank[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.wavelet.access(row)
            row, steps = self.before[c] + self.wavelet.rank(c, row)[0], steps + 1
        return which, at


class Windows:
    """A block of windows with their items, ready to be searched."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        split = [w.encode().split(b" ") for w, _ in rows]
        self.ids = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), FIRST)}
        self.sigma = FIRST + len(self.ids) + OTHERS
        self.lengths = np.array([len(ws) for ws in split], np.int64)
        self.patterns = np.zeros((len(split), int(self.lengths.max(initial=1))), np.int64)
        for row, ws in zip(self.patterns, split, strict=True):
            row[len(row) - len(ws) :] = [self.ids[w] for w in ws]
        self.items = [items for _, items in rows]

    def numbered(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts, each followed by GAP; words of each text)."""
        parts, counts, ends = [], [], itertools.repeat(END)
        for text in texts:
            ws = shared.alnum_words(text.as_py())
            counts.append(len(ws))
            parts += [np.fromiter(map(self.ids.get, ws, ends), np.int32, len(ws)), np.array([GAP], np.int32)]
        a = np.concatenate([np.zeros(0, np.int32), *parts])
        other = np.flatnonzero(a == END)
        a[other] = self.sigma - 1 - other % OTHERS
        return a, np.array(counts, np.int64)

    def find(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position in a) of every occurrence; a holds numbers of whole texts, each followed by GAP."""
        none = np.zeros(0, np.int64)
        found, reach = [(none, none)], self.patterns.shape[1] - 1
        for begin in range(0, len(a) if len(self.lengths) else 0, SHARD):
            index = FMIndex(np.append(a[begin : begin + SHARD + reach], END), self.sigma)
            which, lo, hi = index.search(self.patterns, self.lengths)
            k, at = index.locate(lo, hi)
            found.append((which[k], at + begin))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def spans_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of hit words."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _scan(block, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        for b in batches:
            a, n = windows.numbered(b.column("text"))
            start = np.cumsum(n + 1) - (n + 1)
            which, at = windows.find(a)
            change = np.zeros(len(a) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + windows.lengths[which], -1)
            first, last = spans_of(np.cumsum(change[:-1]) > 0)
            doc = np.searchsorted(start, first, "right") - 1
            spans: list[list] = [[] for _ in n]
            for d, f, e in zip(doc.tolist(), (first - start[doc]).tolist(), (last - start[doc]).tolist(), strict=True):
                spans[d].append({"first": f, "last": e})
            items: list[set] = [set() for _ in n]
            for d, w in np.unique(np.stack([np.searchsorted(start, at, "right") - 1, which]), axis=1).T.tolist():
                items[d].update(windows.items[w])
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(n), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"]
            )

    return run


def windows_of(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, items): each distinct window, its words joined by spaces, and the ids of its items."""
    items = shared.pick(benchmark, item_id="string", text="string")
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    ws = items.select(F.coalesce("item_id", F.lit("")).alias("item"), F.array_remove(F.split(text, NOT_WORD), "").alias("ws"))
    many = F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size))
    each = ws.where(F.size("ws") > 0).select("item", F.explode(F.when(F.size("ws") >= size, many).otherwise(F.array("ws"))).alias("w"))
    return each.groupBy(F.array_join("w", " ").alias("window")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _merged(spans: pd.Series) -> pd.Series:
    def one(x) -> list[dict]:
        out: list[dict] = []
        for f, e in sorted((s["first"], s["last"]) for s in x):
            if out and f <= out[-1]["last"] + 1:
                out[-1]["last"] = max(out[-1]["last"], e)
            else:
                out.append({"first": f, "last": e})
        return out

    return spans.map(one)


@shared.sized
def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of docs (which has ``text``), n_words, spans (hit words, merged) and items (ids)."""
    spark = docs.sparkSession
    windows = shared.settle(windows_of(benchmark, size), "windows")
    cost = F.octet_length("window") + 64 + F.size("items") * 16
    n_blocks = 1 + (windows.agg(F.sum(cost)).first()[0] or 0) // block_bytes
    send = lambda k: spark.sparkContext.broadcast(Windows([(r.window, list(r.items)) for r in windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k).collect()]))
    kept = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"n_words bigint, spans {SPANS}, items array<string>"])
    if n_blocks == 1:
        return shared.in_batches(docs, _scan(send(0), names), schema)
    rows = shared.settle(docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), "text"), "scan-docs")
    found = []
    for k in range(n_blocks):
        block = send(k)
        found.append(shared.settle(shared.in_batches(rows, _scan(block, ["_rid"]), f"_rid bigint, n_words bigint, spans {SPANS}, items array<string>"), f"scan-{k}"))
        block.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    merge = F.pandas_udf(_merged, SPANS)
    per_row = every.groupBy("_rid").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_row = per_row.withColumn("spans", merge("spans"))
    return rows.join(per_row, "_rid").select("_row.*", "n_words", "spans", "items")


def cut(text: str, spans: list, known: set[bytes], size: int = SIZE) -> str:
    """text without the words of the spans, and without windows that only arise where the rest meets."""
    while True:
        at = [m.span() for m in WORD.finditer(text)]
        parts, done = [], 0
        for s in spans:
            parts.append(text[done : at[s["first"]][0]])
            done = at[s["last"]][1]
        text = " ".join([*parts, text[done:]]) if parts else text
        ws = shared.alnum_words(text)
        spans = []
        for n in {k.count(b" ") + 1 for k in known}:
            spans += [{"first": i, "last": i + n - 1} for i in range(len(ws) - n + 1) if b" ".join(ws[i : i + n]) in known]
        if not spans:
            return text
        spans = _merged(pd.Series([spans]))[0]


@shared.sized
def remove_spans(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """documents with the merged spans cut out of ``text``; those without a hit are not touched, nulls stay null.

    Documents that were cut are scanned again for all windows until none is hit, as a window may also arise
    where the rest of a text meets. Each round writes its documents, the later ones only those that were cut.
    """
    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = scan(rows, benchmark, ["row"], size).withColumn("text", F.col("row.text").cast("string"))

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, s) -> str:
            if not len(s):
                return t
            ws = shared.alnum_words(t)
            known = {b" ".join(ws[i : i + size]) for x in s for i in range(x["first"], max(x["first"], x["last"] - size + 1) + 1)}
            return cut(t, list(s), known, size)

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    hit = F.size("spans") > 0
    now = shared.settle(found.select("row", F.when(hit, cleaned("text", "spans")).alias("text"), hit.alias("hit")), "cut-0")
    done = now.where("not hit").withColumn("text", F.col("row.text").cast("string"))
    rounds = 0
    while not (again := now.where("hit")).isEmpty():
        rounds += 1
        found = scan(again.select("row", "text"), benchmark, ["row", "text"], size)
        now = shared.settle(found.select("row", cleaned("text", "spans").alias("text"), hit.alias("hit")), f"cut-{rounds}")
        done = done.union(now.where("not hit"))
    return done.select(*shared.with_text(documents.columns))


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.pick(shared.table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = scan(docs, shared.table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 8), lambda p: ws[p:p + 9]) END) AS w FROM i
), n AS (
  SELECT DISTINCT len(w) AS n FROM w
), dw AS (
  SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, n WHERE len(ws) >= n
), hit AS (
  SELECT rid, n, p, item FROM (SELECT rid, n, p, ws[p:p + n - 1] AS x FROM dw) JOIN w ON x = w.w
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
