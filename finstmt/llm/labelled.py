"""Rows to learn from, in bounded number and never with labels of the held-out fold.

A bound is kept by a share of a hash: of more than ``most`` rows those go on whose hash falls under most / rows,
so about ``most`` remain (a deviation is their square root), without a sort and whatever else is in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls into the fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def thinned(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` of the rows, by a hash of the key."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, only: int | None = None) -> DataFrame:
    """doc_id, text and y of about ``most`` labelled documents outside the fold; ``only``: those of that label.

    Null labels and ids are left out; of several labels of one id the largest counts, of several documents of
    one id the one whose text has the smallest hash, so a labelled id gives one row.
    """
    found = shared.pick(labels, doc_id="bigint", **{label: "int"}).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    found = found.groupBy("doc_id").agg(F.max(label).alias("y"))
    found = thinned(found if only is None else found.where(F.col("y") == only), most, "doc_id")
    docs = shared.pick(documents, doc_id="bigint", text="string")
    each = docs.join(F.broadcast(found), "doc_id")  # about ``most`` rows of two numbers
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")
    return each.groupBy("doc_id", "y").agg(first).select("doc_id", "first.text", "y")


def unlabelled(documents: DataFrame, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id, text of about ``most`` documents outside the fold, whether they have labels or not; repeated rows count once."""
    docs = shared.pick(documents, doc_id="bigint", text="string").where(~held_out("doc_id", folds, fold))
    return thinned(docs, most, "doc_id", "text").dropDuplicates(["doc_id", "text"])
