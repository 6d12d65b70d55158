"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct word shingles (as 64-bit hashes). Documents of equal sets form one
class. Classes that share a MinHash band are candidates; odd sketches of their MinHash samples (bit parities
whose XOR counts the differing samples) estimate the similarity and drop candidates that are clearly below
the limit (``Rule.margin`` of 1 turns this screen off); the rest is confirmed on the full sets, read again
from the texts. A class is known by a number, that of one of its rows.

No bucket is expanded into all its pairs. First each member of a bucket is held against the bucket's hub
only, and links found that way make components. Then only what lies outside a bucket's largest component is
compared, with all that is of another component, in blocks of about ``BLOCK`` members; a larger bucket is dealt
out as pairs of blocks, so none of its pairs is skipped, and a member of a bucket of n is copied n / BLOCK times. Of two
components' pairs in a block pair the nearest few are confirmed first. Block pairs that left out others, and still hold
more than one component after that, are dealt out once more in blocks of ``EXACT`` members and ``EXACT_BYTES`` of full
sets, and gone through pair by pair within their task, so neither the number of rows follows the number of pairs nor
a task's memory the length of the texts.

Hubs, large bands and large components may hold any share of the rows: their joins are spread over parts.

Cases
- null text or no words: empty set, n_shingles 0, linked with nothing (not even with other empty ones).
- fewer words than a shingle has: the whole sequence is the only shingle.
- repeated rows: the same document once more, each with its row; kept where doc_id = component_id.
- a null doc_id never becomes a component_id unless its component has no other; of a component without any
  doc_id one row is kept.
- very long texts are read whole; extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

@dataclass(frozen=True)
class Rule:
    """What is near: shingles of ``words`` words, linked where num / den of their union is shared.

    Two sets at the limit share no band with a probability of (1 - limit^rows)^bands. Estimates by sketch this
    ``margin`` below the limit are dropped: five standard deviations of BINS samples. Of two components' pairs in
    a block pair the ``nearest`` are confirmed first, and ``most_pairs`` of all.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 40
    rows: int = 5
    margin: float = 0.07
    nearest: int = 4
    most_pairs: int = 4096

    @property
    def limit(self) -> float:
        return self.num / self.den


#: The usual rule (1e-7), and that of the contract of op9 (3e-7).
USUAL, CONTRACT = Rule(), Rule(words=3, num=85, bands=32, rows=6)
BIN_BITS, SKETCH_BITS = 10, 2048
BINS = 1 << BIN_BITS
#: Shingles that small sets may lose to a shared bin; estimates may be off by that besides the margin.
LOST = 1.5
#: Members of a block that are compared by sketch (about 264 bytes each), and by full sets (8 bytes a shingle).
BLOCK, EXACT, EXACT_BYTES = 4096, 512, 32 << 20
_W = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > shared.REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _weights(n: int) -> np.ndarray:
    """Odd factors of the words of a shingle."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _W[0]) | np.uint64(1)


def shingles(text: str | None, hashes: dict, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of a shorter text, its whole sequence."""
    ws = shared.space_words(text)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    if len(h) == 0:
        return h
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i, w in enumerate(_weights(size)):
        total += h[i : len(h) - size + 1 + i] * w
    return np.unique(_mix(total))


class MinHash:
    """Samples are 32-bit: halves the work, and sets share one by chance with a probability of about their size / 2^32."""

    def __init__(self, rule: Rule):
        self.rule, n = rule, rule.bands * rule.rows
        self.times = np.random.default_rng(9).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = np.random.default_rng(10).integers(0, 2**32, n, dtype=np.uint32)

    def samples(self, s: np.ndarray) -> np.ndarray:
        best = np.full(len(self.times), np.iinfo(np.uint32).max, np.uint32)
        x = s.astype(np.uint32)[:, None]
        for i in range(0, len(x), 256):
            hashed = x[i : i + 256] * self.times
            hashed += self.plus
            np.minimum(best, hashed.min(axis=0), out=best)
        return best

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """A key for each set (row of samples) and band, the band's own numbers."""
        rows = _mix(samples.astype(np.uint64)).reshape(-1, self.rule.bands, self.rule.rows)
        key = np.arange(1, self.rule.bands + 1, dtype=np.uint64) * _W[0]
        for j in range(self.rule.rows):
            key = _mix(key + rows[:, :, j] * _W[1])
        return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> bytes:
    """The smallest hash of each of BINS bins is a MinHash sample (of one permutation) and flips the bit that
    it hashes to. In front: the set's size and the number of bins in use."""
    bins = s >> np.uint64(64 - BIN_BITS)
    sample = s[np.concatenate([[True], bins[1:] != bins[:-1]])]
    at = (_mix(sample + _W[2]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8))
    return np.array([len(s), len(sample)], "<u4").tobytes() + bits.tobytes()


def sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def estimate(x: np.ndarray, y: np.ndarray, margin: float = Rule.margin) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of sketches (rows of x and y), and how far they may be off.

    The XOR's population count z gives the number of differing samples, -m/2 ln(1 - 2z/m), and so the number
    of equal ones; their share of the bins that either set uses is the similarity.
    """
    z = np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64)
    differing = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * z / SKETCH_BITS, 1e-9))
    (n_x, used_x), (n_y, used_y) = (((v[:, 0] & np.uint64(0xFFFFFFFF)).astype(float), (v[:, 0] >> np.uint64(32)).astype(float)) for v in (x, y))
    equal = np.maximum(used_x + used_y - differing, 0) / 2
    in_use = lambda n: -BINS * np.expm1(n * np.log1p(-1 / BINS))
    scale = (used_x + used_y) / (in_use(n_x) + in_use(n_y))
    j = np.full(len(z), 0.8)
    for _ in range(5):
        j = np.clip(equal / (in_use((n_x + n_y) / (1 + j)) * scale), 0, 1)
    return j, margin + LOST / np.maximum(n_x, n_y)


def _sketch_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = _Hashes(), MinHash(rule)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n", "digest", "sketch")}
            samples = []
            for text in b.column("text"):
                s = shingles(text.as_py(), hashes, rule.words)
                out["n"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["sketch"].append(odd_sketch(s) if len(s) else None)
                if len(s):
                    samples.append(minhash.samples(s))
            keys = minhash.bands(np.stack(samples)) if samples else np.zeros(0, np.int64)
            ends = np.cumsum([0, *(n > 0 for n in out["n"])]) * rule.bands
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("fp"), pa.array(out["n"], pa.int64()), pa.array(out["digest"], pa.binary()), bands, pa.array(out["sketch"], pa.binary())],
                ["doc_id", "fp", "n", "digest", "bands", "sketch"],
            )

    return run


def sketched(docs: DataFrame, rule: Rule) -> DataFrame:
    schema = "doc_id bigint, fp bigint, n bigint, digest binary, bands array<bigint>, sketch binary"
    return shared.in_batches(docs, _sketch_rows(rule), schema)


def _screen(rule: Rule):
    """Pairs whose sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j, off = estimate(*(sketches(b.column(c).to_pylist()) for c in ("sketch_a", "sketch_b")), rule.margin)
                yield b.select(["a", "b"]).filter(pa.array(j >= rule.limit - off))

    return run


def shared_bands(classes: DataFrame) -> DataFrame:
    """(c, band, size) of the buckets that hold more than one class."""
    member = classes.select("c", F.explode("bands").alias("band"))
    sizes = shared.settle(member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band-sizes")
    return shared.join_counted(member, sizes, ["band"], "size")


def with_hub(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """pairs (a, b, n, the number of a's pairs) with ``value`` of both from side (c, value), as value_a and value_b."""
    both = pairs.join(side.toDF("b", f"{value}_b"), "b")
    hubs = pairs.select("a", "n").distinct().join(side.toDF("a", f"{value}_a"), "a")
    return shared.join_spread(both, hubs, "a", "n", "b")


def star_pairs(classes: DataFrame, buckets: DataFrame, rule: Rule, hubs: int = 2) -> DataFrame:
    """(a, b): each class against hubs of its buckets, the ``hubs`` that it shares most bands with.

    A bucket's hub is the member that meets most others over all bands, as the original of edited copies does: the
    copies are nearer to it than to each other.
    """
    crowd = buckets.groupBy("c").agg(F.sum("size").alias("met"))
    hub = buckets.join(crowd, "c").groupBy("band").agg(F.max(F.struct("met", "c"))["c"].alias("a"), F.max("size").alias("size"))
    met = shared.join_spread(buckets, hub, "band", "size", "c").where("c <> a").groupBy("c", "a").agg(F.count("*").alias("bands"))
    best = met.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("bands", "a")), asc=False), 1, hubs).alias("best"))  # a row for each band at most
    pairs = best.select(F.explode("best.a").alias("a"), F.col("c").alias("b"))
    pairs = shared.numbered(shared.settle(pairs, "stars"), "a")
    return shared.in_batches(with_hub(pairs, classes.select("c", "sketch"), "sketch"), _screen(rule), "a bigint, b bigint")


def _near(rule: Rule, i: int, j: int, group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, estimates): members of block i with those of block j that are of other components and near by sketch."""
    labels, blocks = (group.column(c).to_numpy() for c in ("label", "block"))
    sk = sketches(group.column("sketch").to_pylist())
    left = np.flatnonzero(blocks == i)
    right = left if i == j else np.flatnonzero(blocks == j)
    for x in left.tolist():
        ys = right[(right > x) & (labels[right] != labels[x])] if i == j else right[labels[right] != labels[x]]
        if len(ys):
            e, off = estimate(sk[x : x + 1], sk[ys], rule.margin)
            near = e >= rule.limit - off
            yield x, ys[near], e[near]


PAIR = "a bigint, b bigint, label_a bigint, label_b bigint, band bigint, i int, j int"


def _between(rule: Rule, key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Candidate pairs of one block pair, of each two components the nearest; one row without a pair if there are others."""
    band, i, j = (k.as_py() for k in key)
    names, labels = (group.column(c).to_numpy() for c in ("c", "label"))
    best: dict[tuple[int, int], list[tuple]] = {}
    n, others = 0, False
    for x, ys, e in _near(rule, i, j, group):
        for y, near_by in zip(ys.tolist(), e.tolist(), strict=True):
            lo, hi = (x, y) if names[x] < names[y] else (y, x)
            pair = (near_by, int(names[lo]), int(names[hi]), int(labels[lo]), int(labels[hi]))
            at = (min(pair[3:]), max(pair[3:]))
            mine = best.get(at, [])
            if len(mine) < rule.nearest and n < rule.most_pairs:
                best.setdefault(at, mine).append(pair)
                n += 1
            else:
                others = True
                if mine and pair > min(mine):
                    mine[mine.index(min(mine))] = pair
    found = [pair[1:] for mine in best.values() for pair in mine] + [(None,) * 4] * others
    columns = [*zip(*found, strict=True)] or [[]] * 4
    here = [[k] * len(found) for k in (band, i, j)]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("a", "b", "label_a", "label_b", "band", "i", "j"), [*columns, *here], kinds, strict=True)})


def _exact(rule: Rule, key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """(a, b): labels of components of one block pair that are linked on their members' full sets, each new link once."""
    labels = group.column("label").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
    root = {label: label for label in labels}
    found = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, ys, _ in _near(rule, key[1].as_py(), key[2].as_py(), group):
        for y in ys.tolist():
            p, q = top(labels[x]), top(labels[y])
            if p != q and _linked(rule, sets[x], sets[y]):
                root[max(p, q)] = min(p, q)
                found.append((labels[x], labels[y]))
    return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate("ab")})


def dealt_blocks(buckets: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(band, i, j, block, c, label): who meets in block pair (i, j) of a bucket that holds more than one component."""
    member = buckets.join(labels, "c")
    member = shared.settle(member.select("band", "c", "label", "size"), "members")
    each = member.groupBy("band", "label").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    whole = each.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.max("size").alias("size"))
    out, top = F.col("all") - F.col("top.n"), F.col("top.n")
    mixed = whole.where(out > 0).select("band", F.col("top.label").alias("top"), F.ceil(out / block).cast("int").alias("n_out"), F.ceil(top / block).cast("int").alias("n_top"), "size")
    dealt = shared.join_spread(member, shared.settle(mixed, "mixed"), "band", "size", "c")
    # Blocks of the outside come first, 0 to n_out - 1; those of the largest component meet only them.
    outside = F.col("label") != F.col("top")
    block_of = F.pmod(F.xxhash64("c"), F.when(outside, F.col("n_out")).otherwise(F.col("n_top"))) + F.when(outside, 0).otherwise(F.col("n_out"))
    partners = F.sequence(F.lit(0), F.col("n_out") - 1 + F.when(outside, F.col("n_top")).otherwise(0))
    dealt = dealt.select("band", "c", "label", block_of.cast("int").alias("block"), F.explode(partners).alias("other"))
    return dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "label")


def redealt(rest: DataFrame, members: int = EXACT, most_bytes: int = EXACT_BYTES) -> DataFrame:
    """(of, i, j, block, c, label): the block pairs of rest (band, i, j, block, c, label, n shingles) as pairs of smaller
    blocks. ``of`` is the pair that they come from."""
    key = ["band", "i", "j"]
    each = rest.groupBy(*key, "block").agg(F.greatest(F.count("*") / members, F.sum(F.col("n") * 8) / most_bytes).alias("parts"))
    parts = each.groupBy(*key).agg(F.ceil(F.max("parts")).cast("int").alias("m"))
    m, second = F.col("m"), F.col("block") != F.col("i")
    block = F.pmod(F.xxhash64("c", F.lit(1)), m).cast("int") + F.when(second, m).otherwise(0)
    # Blocks of the first are 0 to m - 1, those of the second m to 2m - 1; a block pair with itself has only the former.
    others = F.when(second | (F.col("i") == F.col("j")), F.sequence(F.lit(0), m - 1)).otherwise(F.sequence(m, 2 * m - 1))
    dealt = rest.join(parts, key).select(F.struct(*key).alias("of"), "c", "label", block.alias("block"), F.explode(others).alias("other"))
    return dealt.select("of", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "label")


def cross_pairs(classes: DataFrame, dealt: DataFrame, rule: Rule) -> DataFrame:
    """PAIR rows from all bands, for buckets that hold more than one component."""

    def between(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _between(rule, key, group)

    return dealt.join(classes.select("c", "sketch"), "c").groupBy("band", "i", "j").applyInArrow(between, PAIR)


def _linked(rule: Rule, x: np.ndarray, y: np.ndarray) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return rule.den * inter >= rule.num * (len(x) + len(y) - inter)


def _confirm(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = _Hashes(), {}
        for b in batches:
            fine = []
            for a, ta, tb in zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b"), strict=True):
                if a not in last:  # the join brings a's pairs one after the other
                    last = {a: shingles(ta.as_py(), hashes, rule.words)}
                fine.append(_linked(rule, last[a], shingles(tb.as_py(), hashes, rule.words)))
            yield b.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return run


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, text) of the classes in wanted (c, each once)."""
    source = classes.join(wanted, "c").select("c", "fp", F.col("doc_id").alias("key_id"))
    return docs.join(source, docs["doc_id"].eqNullSafe(source["key_id"]) & (docs["fp"] == source["fp"])).select("c", "text").dropDuplicates(["c"])


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule, name: str) -> DataFrame:
    """The pairs that hold on their full sets."""
    pairs = shared.numbered(shared.settle(pairs, f"pairs-{name}"), "a")
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    texts = shared.settle(texts_of(wanted, classes, docs), f"texts-{name}")
    links = shared.settle(shared.in_batches(with_hub(pairs, texts, "text"), _confirm(rule), "a bigint, b bigint"), f"links-{name}")
    shared.discard(texts)
    return links


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            sets = [shingles(t.as_py(), hashes, rule.words).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(sets, pa.binary())], ["c", "set"])

    return run


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (c, label) after the links between labels (a, b)."""
    merged = components(links).toDF("label", "merged")
    return shared.settle(labels.join(shared.small(merged), "label", "left").select("c", F.coalesce("merged", "label").alias("label")), "labels")


def cross_links(classes: DataFrame, buckets: DataFrame, labels: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """labels (c, label of every class) after all links between components that share a bucket."""
    dealt = shared.settle(dealt_blocks(buckets, labels), "dealt")
    found = shared.settle(cross_pairs(classes, dealt, rule), "cross")
    pairs = found.where("a is not null").select("a", "b", "label_a", "label_b").distinct()
    links = confirmed(pairs.select("a", "b"), classes, docs, rule, "cross")
    after = relabelled(labels, pairs.join(links, ["a", "b"]).select("label_a", "label_b").distinct().toDF("a", "b"))
    again = found.where("a is null").select("band", "i", "j")
    if again.isEmpty():
        return after
    rest = shared.settle(dealt.drop("label").join(shared.small(again), ["band", "i", "j"], "left_semi").join(after, "c"), "rest")
    mixed = rest.groupBy("band", "i", "j").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    rest = shared.settle(redealt(rest.join(mixed, ["band", "i", "j"], "left_semi").join(classes.select("c", "n"), "c")), "rest-mixed")
    sets = shared.settle(shared.in_batches(texts_of(rest.select("c").distinct(), classes, docs), _sets(rule), "c bigint, set binary"), "sets-rest")

    def exact(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _exact(rule, key, group)

    whole = rest.join(classes.select("c", "sketch"), "c").join(sets, "c").groupBy("of", "i", "j").applyInArrow(exact, "a bigint, b bigint")
    return relabelled(after, shared.settle(whole.distinct(), "links-rest"))


def components(links: DataFrame) -> DataFrame:
    """(c, label) of every linked class; label: the smallest class in reach.

    Alternating rounds hang each node's larger neighbours, then its smaller ones, on its smallest neighbour, until
    all that is left is stars; each round is a table, its edges at most as many as the links.
    """
    edges = shared.settle(links.select("a", "b").where("a <> b").distinct(), "edges")
    n = edges.count()
    while n:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = shared.join_counted(around, low, ["a"], total=2 * n).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = shared.settle(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        up = shared.join_counted(down, m, ["u"], total=2 * n).where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        before, edges = edges, shared.settle(up.union(m.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "small-star")
        shared.discard(before, large)
        # Stars: no node hangs on two others, or on one that hangs itself.
        ends = edges.select(F.col("a").alias("c"), F.lit(0).alias("hangs")).union(edges.select("b", F.lit(1)))
        each = ends.groupBy("c").agg(F.sum("hangs").alias("on"), F.min("hangs").alias("least"))
        more = each.agg(F.count_if((F.col("on") > 1) | ((F.col("on") > 0) & (F.col("least") == 0)))).first()[0]
        if not more:
            break
    stars = edges.select(F.col("b").alias("c"), F.col("a").alias("label"))
    return stars.union(edges.select(F.col("a").alias("c"), F.col("a").alias("label")).distinct())


@shared.sized
def labelled(documents: DataFrame, rule: Rule) -> DataFrame:
    """rid, doc_id, fp (hash of the text), n, label of the group (null: an empty set) and its smallest doc_id."""
    docs = shared.pick(documents, doc_id="bigint", text="string").withColumn("fp", F.xxhash64("text"))
    rows = shared.settle(sketched(docs, rule).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    some = rows.where("n > 0")
    sets = shared.settle(some.groupBy("digest").agg(F.min("rid").alias("c"), F.min("doc_id").alias("low"), F.count("*").alias("copies")), "sets")
    classes = shared.settle(some.withColumnRenamed("rid", "c").join(sets.select("c"), "c").select("c", "doc_id", "fp", "n", "bands", "sketch"), "classes")
    buckets = shared.settle(shared_bands(classes), "buckets")
    links = confirmed(star_pairs(classes, buckets, rule), classes, docs, rule, "star")
    own = sets.select("c").join(components(links), "c", "left").select("c", F.coalesce("label", "c").alias("label"))
    labels = cross_links(classes, buckets, shared.settle(own, "labels"), docs, rule)
    of = shared.settle(sets.join(labels, "c").select("digest", "label", "low", "copies"), "classed")
    lowest = of.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    of = shared.settle(shared.join_counted(of, lowest, ["label"], total=of.count()).select("digest", "label", "component_id", "copies"), "grouped")
    rows = shared.join_counted(rows.select("rid", "doc_id", "fp", "n", "digest"), of, ["digest"], "copies", how="left")
    return rows.select("rid", "doc_id", "fp", "n", "label", "component_id")


def find(documents: DataFrame, rule: Rule = USUAL) -> DataFrame:
    """doc_id, fp (hash of the text), n_shingles, component_id, kept for each document."""
    lowest = F.col("doc_id") == F.col("component_id")
    without_ids = F.col("component_id").isNull() & F.col("label").isNotNull()
    kept = F.when(without_ids, F.col("rid") == F.col("label")).otherwise(F.col("label").isNull() | F.coalesce(lowest, F.lit(False)))
    return labelled(documents, rule).select("doc_id", "fp", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"))


@shared.sized
def one_of_each(documents: DataFrame, rule: Rule = USUAL) -> DataFrame:
    """One document of each group, that of the smallest doc_id (null last), then of the smallest text hash.

    Documents without words are near nothing: of these only repeated rows go.
    """
    key = [F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_fp")]
    each = labelled(documents, rule).groupBy("label", "doc_id", "fp").agg(F.count("*").alias("n"))
    alone = F.when(F.col("label").isNull(), F.struct("doc_id", "fp")).alias("alone")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n")).alias("first")
    kept = each.groupBy("label", alone).agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.fp").alias("_fp"), F.col("first.n").alias("_n"))
    kept = shared.settle(kept, "kept")
    rows = documents.select(F.struct("*").alias("row"), *key)
    among = lambda which: rows["_id"].eqNullSafe(which["_id"]) & rows["_fp"].eqNullSafe(which["_fp"])
    once, more = kept.where("_n = 1"), shared.settle(kept.where("_n > 1"), "kept-repeated")
    single, repeated = rows.join(once, among(once), "left_semi"), rows.join(more, among(more), "left_semi").dropDuplicates(["_id", "_fp"])
    return single.unionByName(repeated).select("row.*")


def op9_odd_sketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(shared.table(spark, sf_dir, "documents"), CONTRACT).drop("fp")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda p: ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2]) END) AS gram FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), inter AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), e AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.node = e.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
