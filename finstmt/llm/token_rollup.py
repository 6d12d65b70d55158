"""Token counts as delta-maintained rollups.

A change to the corpus is a set of signed rows: an insert adds a document's count, a delete takes it away, a
revised count takes the old one away and adds the new. A batch is first summed by source, language and
tokenizer version, then written as an attempt, and counts once its manifest row is written; of several
attempts at one batch the first committed one counts, so a batch may be sent again at any time. Totals are
sums over committed batches and never touch documents again. ``changes`` makes the signed rows of two states of the
documents, by doc_id: what went, what came, and what has another count, source or language now. ``compact`` sums the
committed batches into one and names those that it covers, so totals read one batch and what came after; a batch that
was covered stays known, so sending it again changes nothing. Compactions run one at a time.

Cases
- null or empty text: a document of 0 tokens. Null source or lang: groups of their own.
- repeated rows: each is a document that adds its count; of two states their numbers are compared. Rows of a null doc_id
  count too, and are told apart by the rest of the row.
- very long texts are counted whole.
- an empty batch can be committed; before the first batch, or of an empty table, there are no totals. Extra columns
  are ignored.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
MANIFEST = "batch string, attempt string, committed_at double"
#: Attempts that a compaction (an attempt too) stands for.
COVERED = "attempt string, `by` string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text")
        n = pa.array([len(tokens.ids(t.as_py())) for t in texts], pa.int64())
        words = pa.array([len(shared.space_words(t.as_py())) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang")), n, words], ["doc_id", "source", "lang", "bpe", "words"])


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, bpe and words: one reading of the texts for both tokenizers."""
    docs = shared.pick(documents, doc_id="bigint", source="string", lang="string", text="string")
    return shared.in_batches(docs, _count, "doc_id bigint, source string, lang string, bpe bigint, words bigint")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Inserts (1) or deletes (-1) of rows (source, lang, tokenizer, n_tokens)."""
    return rows.select(*KEY, F.lit(sign).cast("bigint").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows from state old to state new (doc_id, source, lang, tokenizer, n_tokens): rows of one document that
    are in both cancel out, so what is left are deletes, inserts, and both for a revised count."""
    row = ["doc_id", *KEY, "n_tokens"]
    both = new.select(*row, F.lit(1).alias("sign")).unionByName(old.select(*row, F.lit(-1).alias("sign")))
    left = both.groupBy(*row).agg(F.sum("sign").alias("n_docs")).where("n_docs <> 0")
    return left.select(*KEY, "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_tokens"))


def create(spark: SparkSession, root: str) -> None:
    """An empty rollup; ``totals`` works from here on."""
    spark.createDataFrame([], f"{DELTA}, batch string").write.mode("append").parquet(f"{root}/deltas/attempt=none")
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    spark.createDataFrame([], COVERED).write.mode("append").parquet(f"{root}/covered")


def commit(spark: SparkSession, root: str, batch: str, changes: DataFrame) -> None:
    """Add a batch of signed rows once, however often it is sent."""
    _write(spark, root, batch, uuid.uuid4().hex, _summed(changes))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def _write(spark: SparkSession, root: str, batch: str, attempt: str, delta: DataFrame) -> None:
    delta.select(*KEY, "n_docs", "n_tokens", F.lit(batch).alias("batch")).write.parquet(f"{root}/deltas/attempt={attempt}")
    spark.createDataFrame([(batch, attempt, time.time())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _folder(spark: SparkSession, name: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    files, path = _folder(spark, name)
    return files.exists(path)


def live(spark: SparkSession, root: str) -> DataFrame:
    """batch and attempt of what totals are made of: of each committed batch its first attempt, unless a committed
    compaction covers it."""
    done = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    first = done.groupBy("batch").agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    if not _exists(spark, f"{root}/covered"):
        return first
    covered = spark.read.schema(COVERED).parquet(f"{root}/covered").join(done.select(F.col("attempt").alias("by")), "by", "left_semi")
    return first.join(covered, "attempt", "left_anti")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """n_docs and n_tokens by source, lang and tokenizer over the committed batches."""
    deltas = spark.read.schema(f"{DELTA}, batch string, attempt string").parquet(f"{root}/deltas")
    return _summed(deltas.join(live(spark, root), ["batch", "attempt"], "left_semi"))


def compact(spark: SparkSession, root: str) -> None:
    """Sum all live batches into one, which covers them once its manifest row is there."""
    attempt = uuid.uuid4().hex
    covers = live(spark, root).select("attempt", F.lit(attempt).alias("by"))
    covers.coalesce(1).write.mode("append").parquet(f"{root}/covered")
    held = spark.read.schema(COVERED).parquet(f"{root}/covered").where(F.col("by") == attempt).select("attempt")
    deltas = spark.read.schema(f"{DELTA}, batch string, attempt string").parquet(f"{root}/deltas")
    _write(spark, root, f"compaction-{attempt}", attempt, _summed(deltas.join(held, "attempt", "left_semi")))


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove deltas that no total reads; of attempts that are at work there must be none. The number of attempts removed."""
    files, deltas = _folder(spark, f"{root}/deltas")
    kept = {r.attempt for r in live(spark, root).select("attempt").collect()} | {"none"}  # a row for each batch since the last compaction
    idle = [s.getPath() for s in files.listStatus(deltas) if s.getPath().getName().removeprefix("attempt=") not in kept]
    for p in idle:
        files.delete(p, True)
    return len(idle)


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents, after these batches: every document is inserted with its word count under both
    tokenizer versions; the subword counts are revised to exact ones, by doc_id; documents without any subword are deleted,
    all batches are compacted, those documents are inserted again; and the revision is sent a second time, which changes
    nothing."""
    root = shared.new_path(spark, "token-rollup")
    create(spark, root)
    found = shared.settle(counts(shared.table(spark, sf_dir, "documents")), "token-counts")
    rows = lambda version, n: found.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"))
    bpe, words = "byte_bpe_50k", "white_space"
    commit(spark, root, "1-load", signed(rows(bpe, "words").union(rows(words, "words")), 1))
    revision = changes(rows(bpe, "words"), rows(bpe, "bpe"))
    commit(spark, root, "2-exact", revision)
    without = rows(bpe, "bpe").where("n_tokens = 0")
    commit(spark, root, "3-take-out", signed(without, -1))
    compact(spark, root)
    commit(spark, root, "4-put-back", signed(without, 1))
    commit(spark, root, "2-exact", revision)
    return totals(spark, root)


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_token_rollup that SQL can express: totals of the white-space tokenizer."""
    return op1_token_rollup(spark, sf_dir).where("tokenizer = 'white_space'")


WORDS_SQL = r"""
SELECT source, lang, 'white_space' AS tokenizer, count(*) AS n_docs,
  CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens
FROM documents GROUP BY source, lang
"""
