"""Personal data by bootstrapped contextual extraction.

Base spans come from fixed forms (email, ip, card, phone). They seed a bootstrap: every run of groups that looks
like an identifier is a slot with the words to its left as lexical patterns; patterns and instances make a graph
whose edges are (pattern, instance) pairs. Rounds of Spark joins score patterns by the instances they yield
and instances by the patterns they stand in, starting from the seeds, until no pattern is new; slots that stand in a pattern of high
confidence become spans of its kind, so that identifiers of no fixed form are found. Texts are read once:
base spans and slots are written, and all rounds run over the slots.

A slot is a run of groups with a digit, joined by dots, hyphens, colons and the like; groups of digits or capitals
also by single spaces and brackets ('(212) 555-0147'). Tokens around an @ and IPv6 addresses need no digit.

A pattern needs ``MIN_SUPPORT`` distinct instances, and a score of ``MIN_SCORE``: the mean confidence that its
instances are of the kind, over those known and those against it, which are known as another kind or cannot have
the kind's form (a date is no phone number). Unknown instances of a possible form count for neither side; the
known ones together need the confidence of the least pattern that none is unknown in, ``MIN_SUPPORT * MIN_SCORE``.
A new instance is as sure as its best pattern, lessened by ``DECAY`` each round; a pattern, once accepted, stays.
A pattern that very many instances share (':') meets in no single task: its sums are formed before the shuffle, and
what is known of accepted patterns is broadcast where it is small.

Cases
- null text: empty, no spans. Very long texts are searched whole. Repeated rows: each is searched alone; equal instances count once in a pattern.
- a group that overlaps a base span is never part of a slot of another kind; spans of one kind never overlap.
- between kinds: one whose form the slot may have, then the higher pattern score, then the order of KINDS.
- groups of one list, with single spaces between them, are one slot.
- a null doc_id keeps its row. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

KINDS = ("email", "ip", "card", "phone")
LEFT_WORDS = 2
MIN_SUPPORT, MIN_SCORE, DECAY = 5, 0.8, 0.9

# Fixed forms. Possessive repeats and the look-behind only save time: they find the same spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MIN_SLOT = 6
# A token with a digit, an @ or two colons in a row; the look-behind and possessive repeats keep it linear.
_TOKEN = re.compile(r"(?<![\w.%+@/:-])[A-Za-z_.%+/-]*+(?::[A-Za-z_.%+/-]++)*+(?::?[0-9@]|::)[\w.%+@/:-]*+", re.ASCII)
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9A-Fa-f]{0,4}")
_ADDRESS = re.compile(r"[^@]+@[^@]+")
#: Groups that go on over a space or bracket, and what may stand between them.
_LOOSE, _BETWEEN = re.compile(r"[0-9A-Z.+/:-]+"), frozenset([" ", "(", ")", "[", "]", " (", ") ", " [", "] ", "-(", ")-", "]:", ".(", ")."])
_BRACKETS = {")": "(", "]": "["}
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?: [0-9:.]+)?")
_NUMBER = re.compile(r"[0-9+ ()\[\]./-]+")
_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/][0-9]+)?")
_CONTEXT = re.compile(r"[^\W\d_]+|[:=#]")
_NEAR = 64


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no match can begin before this sign and go beyond it
        at = text.find("@", free)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class Contexts:
    """Lexical patterns on the left of places in a text."""

    def __init__(self, text: str):
        self.text, self.words = text, None

    def before(self, start: int) -> list[str]:
        """The last word or sign on the left, and the last LEFT_WORDS together."""
        words = [m[0] for m in _CONTEXT.finditer(self.text, max(0, start - _NEAR), start)][1 if start > _NEAR else 0 :]
        if len(words) < LEFT_WORDS and start > _NEAR:  # they lie further off, or the first may be cut
            if self.words is None:
                self.words = [m.span() for m in _CONTEXT.finditer(self.text)]
            last = bisect.bisect_left(self.words, (start, 0))
            words = [self.text[s : min(e, start)] for s, e in self.words[max(0, last - LEFT_WORDS) : last]]
        words = [w.lower() for w in words[-LEFT_WORDS:]]
        return [" ".join(words[-k:]) for k in range(1, len(words) + 1)]


def _groups(token: str, at: int) -> Iterator[tuple[int, int]]:
    """The parts of a token, as places in the text, that are identifiers: pieces between colons stay joined."""
    pieces = token.split(":")
    hexes = len(pieces) > 2
    start, first, last = at, None, at
    for piece in [*pieces, None]:
        if piece is not None and (_DIGIT.search(piece) or _ADDRESS.fullmatch(piece) or (hexes and _HEX.fullmatch(piece))) and not piece.startswith("@"):
            first, last = start if first is None else first, start + len(piece)
        elif first is not None:
            run = token[first - at : last - at]
            begin = len(run) - len(run.lstrip("_.%@/-:"))
            end = len(run.rstrip("_.%+@/-:"))
            # The two colons that an IPv6 address may begin or end with are its own.
            begin -= 2 * run[:begin].endswith("::")
            end += 2 * run[end:].startswith("::")
            part = run[begin:end]
            if _DIGIT.search(part) or "@" in part or (part.count(":") > 1 and part.strip(":")):
                yield first + begin, first + end
            first = None
        start += len(piece or "") + 1


def runs(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Where slots lie that overlap no base span."""
    taken, i = sorted((s, e) for _, s, e in base), 0
    start = end = None
    opened: list[str] = []
    loose = False
    for m in _TOKEN.finditer(text):
        for s, e in _groups(m[0], m.start()):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i < len(taken) and taken[i][0] < e:
                continue
            goes_on = bool(_LOOSE.fullmatch(text, s, e))
            if start is not None and loose and goes_on and s - end <= 2 and text[end:s] in _BETWEEN:
                end = e
                continue
            if start is not None:
                yield _bracketed(text, start, end)
            start, end, loose = s, e, goes_on
    if start is not None:
        yield _bracketed(text, start, end)


def _bracketed(text: str, start: int, end: int) -> tuple[int, int]:
    """With the bracket before it that is closed inside, and the one after it that is opened inside."""
    depth = {"(": 0, "[": 0}
    for c in text[start:end]:
        if c in depth:
            depth[c] += 1
        elif c in _BRACKETS:
            depth[_BRACKETS[c]] -= 1
    before = text[start - 1 : start]
    after = text[end : end + 1]
    start -= depth.get(before, 0) < 0
    return start, end + (depth.get(_BRACKETS.get(after, ""), 0) > 0)


def _ip_form(instance: str) -> bool:
    if instance.count(":") < 2:
        return bool(_DOTTED.fullmatch(instance))
    try:
        return bool(ipaddress.IPv6Address(instance.lstrip("[").split("]")[0].split("/")[0]))
    except ValueError:
        return False


def form(instance: str) -> int:
    """Bits of those of KINDS whose form it may have."""
    digits = len(_NOT_DIGIT.sub("", instance))
    number = bool(_NUMBER.fullmatch(instance)) and not _DATE.fullmatch(instance)
    return sum(f << i for i, f in enumerate(["@" in instance, _ip_form(instance), number and 12 <= digits <= 19, number and 6 <= digits <= 15]))


def may_be(kind: str) -> Column:
    return F.col("form").bitwiseAND(1 << KINDS.index(kind)) > 0


def _slot(kind: str | None, text: str, s: int, e: int, patterns: list[str]) -> dict:
    own = 1 << KINDS.index(kind) if kind else 0
    return {"kind": kind, "first": s, "last": e, "instance": xxhash.xxh64_intdigest(text[s:e]) - (1 << 63), "form": form(text[s:e]) | own, "patterns": patterns}


def slots(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Base spans, and runs that look like identifiers and overlap none, with their patterns."""
    at = Contexts(text)
    out = [_slot(kind, text, s, e, at.before(s)) for kind, s, e in base]
    for s, e in runs(text, base):
        patterns = at.before(s) if e - s >= _MIN_SLOT else []
        if patterns:
            out.append(_slot(None, text, s, e, patterns))
    return out


_SLOT_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("instance", pa.int64()), ("form", pa.int64()), ("patterns", pa.list_(pa.string()))]))
_SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, slots array<struct<kind:string,first:bigint,last:bigint,instance:bigint,form:bigint,patterns:array<string>>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        base, found = [], []
        for x in b.column("text"):
            text = x.as_py() or ""
            spans = base_spans(text)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in spans))
            base.append(_joined(spans))
            found.append(slots(text, spans))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(found, _SLOT_TYPE)],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base", "slots"],
        )


def score_patterns(edges: DataFrame, seeds: DataFrame, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, decay: float = DECAY) -> DataFrame:
    """(pattern, kind, score) of the accepted patterns.

    edges: distinct (pattern, instance, form), settled; seeds: distinct (instance, kind). In each round a pattern's
    score for a kind is the mean confidence over its instances that are known or against the kind; an instance's
    confidence is 1 for a seed, else its best accepted pattern's score times ``decay``. A pattern keeps its best
    score, so rounds end: each but the last accepts a pattern for one more kind.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(~may_be(k)).alias(f"not_{k}") for k in KINDS)).where(F.col("n") >= min_support)
    sizes = shared.settle(sizes, "pii-sizes")
    graph = shared.settle(shared.join_counted(edges, sizes, ["pattern"]).select("pattern", "instance", "form"), "pii-graph")
    sure = seeds.select("instance", "kind", F.lit(1.0).alias("confidence"))
    known, accepted, n = sure, None, 0
    while True:
        by_kind = known.groupBy("instance").agg(*(F.max(F.when(F.col("kind") == k, F.col("confidence"))).alias(k) for k in KINDS))
        met = graph.join(by_kind, "instance").groupBy("pattern")
        # Against a kind: all that cannot be of it. Of those that can, only the known ones, of whatever kind, are counted.
        sums = [x for k in KINDS for x in (F.coalesce(F.sum(k), F.lit(0.0)).alias(f"sum_{k}"), F.count_if(may_be(k)).alias(f"known_{k}"))]
        each = [F.struct(F.lit(k).alias("kind"), F.col(f"sum_{k}").alias("sum"), (F.col(f"not_{k}") + F.col(f"known_{k}")).alias("of")) for k in KINDS]
        scored = met.agg(*sums).join(sizes, "pattern").select("pattern", F.explode(F.array(*each)).alias("s")).select("pattern", "s.*")
        score = scored.where(F.col("sum") >= min_support * min_score).select("pattern", "kind", (F.col("sum") / F.col("of")).alias("score")).where(F.col("score") >= min_score)
        if accepted is not None:
            score = score.union(accepted).groupBy("pattern", "kind").agg(F.max("score").alias("score"))
        accepted = shared.settle(score, "pii-patterns")
        before, n = n, accepted.count()
        if n == before:
            return accepted
        new = graph.join(shared.small(accepted), "pattern").select("instance", "kind", (F.col("score") * decay).alias("confidence"))
        known = sure.union(new)


@shared.sized
def extract(documents: DataFrame, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, base counts, ``base`` and ``spans`` (all spans, joined), with ``rid`` a number for the row."""
    docs = shared.pick(documents, doc_id="bigint", text="string")
    read = shared.settle(shared.in_batches(docs, _read, _SCHEMA).withColumn("rid", F.monotonically_increasing_id()), "pii-slots")
    each = read.select("rid", F.explode("slots").alias("s")).select("rid", "s.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "form").groupBy("pattern", "instance").agg(F.bit_or("form").alias("form"))
    edges = shared.settle(edges, "pii-edges")
    seeds = shared.settle(each.where("kind is not null").select("instance", "kind").distinct(), "pii-seeds")
    accepted = score_patterns(edges, seeds, min_support=min_support, min_score=min_score)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order")
    fits = F.coalesce(*(F.when(F.col("kind") == k, may_be(k)) for k in KINDS)).alias("fits")
    slot = each.where("kind is null").select("rid", "first", "last", "form", F.explode("patterns").alias("pattern"))
    best = slot.join(shared.small(accepted), "pattern").groupBy("rid", "first", "last").agg(F.max(F.struct(fits, "score", -order, "kind")).alias("best"))
    added = best.groupBy("rid").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "first", "last")).alias("added"))
    return read.drop("slots").join(added, "rid", "left").withColumn("spans", _with_added("base", "added"))


@F.pandas_udf(T.StringType())
def _with_added(base: pd.Series, added: pd.Series) -> pd.Series:
    def one(b: str, more) -> str:
        if more is None or not len(more):
            return b
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
        spans += [(x["kind"], x["first"], x["last"]) for x in more]
        return _joined(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))

    return pd.Series([one(b, m) for b, m in zip(base, added, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t: str | None, joined: str | None) -> str | None:
        if not joined or not t:
            return t
        out, done = [], 0
        for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in joined.split(","))):
            if e > done:
                out += [t[done:s], f"<{k}>"] if s >= done else []
                done = e
        return "".join([*out, t[done:]])

    return pd.Series([one(t, j) for t, j in zip(text, spans, strict=True)], dtype=object)


@shared.sized
def redact(documents: DataFrame) -> DataFrame:
    """documents with every span's text replaced by its kind in angle brackets; other columns stay."""
    rows = documents.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row"))
    rows = shared.settle(rows, "pii-docs").withColumn("text", F.col("row.text").cast("string"))
    spans = extract(rows.select(F.col("n").alias("doc_id"), "text")).select(F.col("doc_id").alias("n"), "spans").where("spans <> ''")
    found = rows.select("n", "row").join(spans, "n", "left").withColumn("text", F.col("row.text").cast("string"))
    masked = F.when(F.col("spans").isNotNull(), _masked("text", "spans")).otherwise(F.col("text"))
    return found.withColumn("text", masked).select(*shared.with_text(documents.columns))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_bootstrapped_pii that SQL can express: the counts of the base forms."""
    return op3_bootstrapped_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in KINDS))


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
    regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_filter(list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: len(x) BETWEEN 16 AND 19) AS cards,
    list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones
  FROM d
)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email,
  CAST(len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(cards, lambda x: list_sum(list_transform(range(1, len(x) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[len(x) - i + 1] AS INT) ELSE (2 * CAST(x[len(x) - i + 1] AS INT)) // 10 + (2 * CAST(x[len(x) - i + 1] AS INT)) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phones, lambda n: n BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
FROM f
"""
