"""Item details: a value with the cell that it was read from, how sure it is, and why.

What a detail tells comes with the value through the aggregation that picks an item's first match (``origin`` of
accounts.extract and documents.extract); nothing is looked up again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, catalog, text

#: Fields of a source; those that do not apply are null.
SOURCE = (
    "source_type", "fs_div", "statement", "account_id", "account_nm", "currency", "ord", "table_id", "row_id", "row_label", "normalized_row_label", "column_id", "column_label",
    "unit_confidence", "depreciation_source", "ai_source", "disagreement", "previous_source", "rcept_no", "report_nm", "path", "report_type",
)


def source(**known: Column) -> Column:
    return F.struct(*(known.get(k, F.lit(None)).cast("string").alias(k) for k in SOURCE))


def unique_flags(flags: Column) -> Column:
    """In order of first occurrence, without empty ones."""
    return F.array_distinct(F.filter(flags, lambda x: x.isNotNull() & (x != "")))


def detail(value: Column, raw: Column, unit: Column, of: Column, confidence: Column, flags: Column, state: Column | None = None) -> Column:
    """A null value is never verified: its confidence is missing."""
    sure = F.when(value.isNull() & (confidence == "verified"), "missing").otherwise(confidence)
    return F.struct(
        value.cast("double").alias("value"), raw.cast("string").alias("raw_value"), unit.cast("bigint").alias("unit_multiplier"), F.lit("KRW").alias("normalized_value_unit"), of.alias("source"), sure.alias("confidence"),
        (F.when(value.isNull(), "missing").otherwise("extracted") if state is None else state).alias("value_state"), unique_flags(flags).alias("flags"),
    )


def empty(of: Column, flags: Column) -> Column:
    """The detail of an item without a value."""
    nothing = F.lit(None)
    return detail(nothing, nothing, nothing, of, F.lit("missing"), flags)


def _said(c: Column) -> Column:
    return F.nullif(text.trim(c), F.lit(""))


def of_accounts(found: DataFrame) -> DataFrame:
    """Adds ``detail`` to accounts.extract(origin=True)."""
    row, by_name = F.col("origin"), F.col("method") == "account_nm"
    other = F.col("currency_code") != "KRW"
    flags = F.array(F.concat(F.lit("matched_by_"), "method"), F.when(by_name, F.concat(F.lit("matched_keyword:"), "keyword")), F.when(F.col("turned"), F.lit("negated_by_label")), F.when(other, F.concat(F.lit("non_krw_currency:"), "currency_code")))
    of = source(
        source_type=F.lit("dart_api"), fs_div=_said(row["fs_div"]), statement=_said(row["sj_div"]), account_id=_said(row["account_id"]), account_nm=_said(row["account_nm"]), currency=F.col("currency_code"), ord=_said(row["ord"]),
        column_id=F.lit("thstrm_amount"), column_label=text.trim(F.coalesce(F.nullif(row["thstrm_nm"], F.lit("")), F.lit("당기"))),
    )
    return found.withColumn("detail", detail(F.col("value"), row["thstrm_amount"], F.lit(1), of, F.col("confidence"), flags))


def of_documents(found: DataFrame) -> DataFrame:
    """Adds ``detail`` to documents.extract(origin=True). Tables are named by statement and place, rows and columns count from 1."""
    place = lambda letter, c: F.concat(F.lit(letter), (F.col(c) + 1).cast("string"))
    at = source(
        source_type=F.lit("document_xml"), statement=F.col("statement"), table_id=F.concat("statement", F.col("table_no").cast("string")), row_id=place("R", "row_id"), row_label=F.col("row_label"), normalized_row_label=F.col("normalized_label"),
        column_id=place("C", "column_id"), column_label=F.col("column_label"), unit_confidence=F.col("unit_confidence"),
    )
    assumed = ~F.col("numeric")
    flags = F.array(
        F.lit("matched_by_normalized_label"), F.when(assumed, F.lit("non_numeric_current_cell_zero_assumed")), F.when(~F.col("known"), F.lit("current_column_not_detected")), F.when(~F.col("known"), F.lit("first_numeric_column_used")),
        F.when(F.col("forced"), F.lit("force_positive")), F.when(F.col("turned"), F.lit("negated_by_label")), F.when(F.col("unit_confidence") == "assumed_won", F.lit("unit_assumed_won")),
    )
    state = F.when(assumed, "zero_assumed_from_non_numeric_current_cell").otherwise("extracted")
    return found.withColumn("detail", detail(F.col("value"), F.col("raw_value"), F.col("unit"), at, F.col("confidence"), flags, state))


def of_depreciation(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, detail of the three amounts of analysis.result_of() (with fs_div): their place is in the trace."""
    kinds = F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("depr", "rou", "amort")))
    each = found.select(*keys, "source", "fs_div", "combined", F.explode(kinds).alias("x")).select(*keys, "source", "fs_div", "combined", "x.*")
    of = source(source_type=F.lit("depreciation_extractor"), fs_div=F.col("fs_div"), depreciation_source=F.col("source"))
    both = F.col("combined") & (F.col("item") == "depr") & F.col("value").isNotNull()
    flags = F.array(F.lit("depreciation_position_in_trace"), F.when(both, F.lit("combined_depreciation_and_amortization")))
    nothing = F.lit(None)
    return each.select(*keys, "item", detail(F.col("value"), nothing, nothing, of, F.lit("verified"), flags).alias("detail"))


def every_item(found: DataFrame, filings: DataFrame, keys: list[str], source_type: str) -> DataFrame:
    """keys, item, detail for each of the twelve items of every filing; those not found are empty and say so."""
    items = F.array(*(F.struct(F.lit(i[0]).alias("item"), F.lit(i[2]).alias("_statement")) for i in catalog.ITEMS))
    all_of = filings.select(*keys, F.explode(items).alias("i")).select(*keys, "i.*")
    of = source(source_type=F.lit(source_type), statement=F.col("_statement") if source_type == "document_xml" else F.lit(None))
    return all_of.join(found.select(*keys, "item", "detail"), [*keys, "item"], "left").select(*keys, "item", F.coalesce("detail", empty(of, F.array(F.lit("not_found")))).alias("detail"))


def annotate(d: Column, **report: Column) -> Column:
    """Report keys are put in where the source has none."""
    filled = d["source"]
    for k, v in report.items():
        filled = filled.withField(k, F.coalesce(d["source"][k], v.cast("string")))
    return d.withField("source", filled)


def final(d: Column, value: Column, ai_source: Column | None = None, disagreement: Column | None = None) -> Column:
    """A detail after a comparison: an unchanged value keeps it; a removed one is missing and tells where it came from;
    a changed or filled one has no cell and is unverified. No detail (null) has no value."""
    nothing, by = F.lit(None), (F.lit(None) if ai_source is None else ai_source)
    kind = F.lit("ai_comparison")
    removed = empty(source(source_type=kind, ai_source=by, previous_source=F.to_json(d["source"])), F.array(F.lit("final_value_removed_by_ai_comparison")))
    said = source(source_type=kind, ai_source=by, disagreement=F.lit(None) if disagreement is None else disagreement)
    new = detail(value, nothing, nothing, said, F.lit("unverified_ai_value"), F.array(F.lit("ai_numeric_without_source")))
    return F.when(amounts.same(d["value"], value), d).when(value.isNull(), removed).otherwise(new)


def values(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a map item → value of details."""
    pairs = F.collect_list(F.struct("item", F.col("detail.value").alias("value")))
    return found.groupBy(*keys).agg(F.map_from_entries(F.sort_array(pairs)).alias("items"))


def successful(items: Column, least: int = 4) -> Column:
    """At least so many values of a map item → value are there."""
    return F.size(F.filter(F.map_values(items), lambda v: v.isNotNull())) >= least
