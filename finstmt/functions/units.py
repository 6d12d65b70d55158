"""Unit captions to multipliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, contains_any

# Unit names and their multipliers.
UNITS = {"원": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}
_TOKEN = rf"천{WS}*원|백{WS}*만{WS}*원|억{WS}*원"
# How captions state a unit.
STRICT = rf"(?i)(?:단위|금액{WS}*단위){WS}*[:：]?{WS}*[\(\[]?{WS}*({_TOKEN}|원|KRW){WS}*[\)\]]?"
LOOSE = rf"단위.{{0,12}}?({_TOKEN})"


def _multiplier(token: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in {"KRW": 1, **UNITS}.items() for x in kv))
    return F.try_element_at(known, F.upper(F.regexp_replace(token, f"{WS}+", "")))  # names the token once


def in_text(c: Column) -> Column:
    """The multiplier that a text names, null where it names none."""
    return F.when(contains_any(c, ["단위"]), F.coalesce(_multiplier(F.regexp_extract(c, STRICT, 1)), _multiplier(F.regexp_extract(c, LOOSE, 1))))


def first_in(texts: Column) -> Column:
    """Of an array of texts, the first that names a unit."""
    return F.get(F.filter(F.transform(texts, in_text), lambda u: u.isNotNull()), F.lit(0))


def of_table(previous: Column, parent_previous: Column, head_cells: Column, rows: Column) -> Column:
    """(unit, unit_confidence): up to five texts before the table, three before its parent, its first five
    physical rows; then its first five rows; else won is assumed."""
    tag = F.coalesce(first_in(F.slice(previous, 1, 5)), first_in(F.slice(parent_previous, 1, 3)), first_in(head_cells))
    inside = first_in(F.flatten(F.slice(rows, 1, 5)))
    sure = F.when(tag.isNotNull(), "detected_from_tag").when(inside.isNotNull(), "detected_from_rows").otherwise("assumed_won")
    return F.struct(F.coalesce(tag, inside, F.lit(1)).cast("bigint").alias("unit"), sure.alias("unit_confidence"))


def name(multiplier: Column) -> Column:
    out = F.concat(multiplier.cast("string"), F.lit("원"))
    for label, value in UNITS.items():
        out = F.when(multiplier == value, label).otherwise(out)
    return out
