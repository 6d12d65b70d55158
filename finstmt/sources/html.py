"""Statements in HTML pages of unknown encoding: their tables as grids, and the items of older filings that have nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, text, units
from . import shred
from .settled import bounded

MOST_BYTES = 10 * 1024 * 1024
TABLE = "doc_id string, table_no int, rows array<array<string>>, prev_texts array<string>, parent_prev_texts array<string>, head_tr_texts array<string>"
#: Bytes in which a page may declare its encoding; fixed values: what declarations of the two encodings hold.
HEAD = 2000
UTF8, KOREAN = (b"charset=utf-8", b'charset="utf-8"'), (b"euc-kr", b"ks_c_5601", b"cp949")


def encoding(content: bytes) -> str:
    """What the page says; else UTF-8 if it is that, else EUC-KR."""
    head = content[:HEAD].lower()
    if any(x in head for x in UTF8):
        return "utf-8"
    if any(x in head for x in KOREAN):
        return "euc-kr"
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        return "euc-kr"
    return "utf-8"


def page_tables(content: bytes) -> list[dict]:
    """The tables of a page in order, those within others too, each with its own cells only; empty rows go."""
    out = []
    for e in shred._read(content.decode(encoding(content), "replace")).below("table"):
        head = [tr for _, tr in zip(range(5), e.below("tr"), strict=False)]
        rows = [r for r in shred.grid(e) if any(r)]
        out.append({"table_no": len(out) + 1, "rows": rows, "prev_texts": shred._previous(e, 10), "parent_prev_texts": shred._previous(e.parent, 3), "head_tr_texts": [c.text() for tr in head for c in tr.below(*shred.CELLS)]})
    return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    kinds = {"table_no": pa.int32(), "rows": pa.list_(texts), "prev_texts": texts, "parent_prev_texts": texts, "head_tr_texts": texts}
    return shred.in_rows(batches, page_tables, kinds)


def tables(pages: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """TABLE rows of pages (doc_id string, content binary); larger pages are left out."""
    content = F.col("content").cast("binary")
    return bounded(pages.select("doc_id", content.alias("content")).where(F.octet_length("content") <= most_bytes)).mapInArrow(_tables, TABLE)


def items(of: DataFrame, catalogue: DataFrame) -> DataFrame:
    """doc_id, item, value by the older rule: of the first table that has one, the first row whose label is a keyword
    and that has a number in the table's first column of numbers, times the table's unit. Signs stay as they are."""
    width = F.array_max(F.transform("rows", F.size))
    number = lambda r, j: amounts.cell_amount(F.get(r, j)).isNotNull()
    columns = F.filter(F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1))), lambda j: F.exists("rows", lambda r: number(r, j)))
    no_texts = F.array().cast("array<string>")
    unit = units.of_table(*(F.coalesce(c, no_texts) for c in ("prev_texts", "parent_prev_texts", "head_tr_texts")), F.col("rows"))
    each = of.where(F.size("rows") > 0).withColumn("_u", unit).select("doc_id", "table_no", F.col("_u.unit").alias("unit"), F.get(columns, F.lit(0)).alias("j"), F.posexplode("rows").alias("row_no", "row"))
    each = each.select("doc_id", "table_no", "row_no", text.label(F.coalesce(F.get("row", F.lit(0)), F.lit(""))).alias("label"), (amounts.cell_amount(F.get("row", F.col("j"))) * F.col("unit")).alias("value")).where("value IS NOT NULL")
    hit = each.join(F.broadcast(catalogue.select("item", F.explode("keywords").alias("label"))), "label")
    return hit.groupBy("doc_id", "item").agg(F.min_by("value", F.struct("table_no", "row_no")).alias("value"))
