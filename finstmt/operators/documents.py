"""Items from statement documents: nodes are (keys, pos, kind, title_text, rows, prev_texts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, catalog, text, units

KEYS = ["corp", "year"]


def _order() -> Window:
    """From a document's start to the node. A document is one partition key; documents are many."""
    return Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _section() -> Column:
    """The section of the latest title that names one."""
    t, s = text.title(F.col("title_text")), F.lit(None).cast("string")
    for word, name in reversed(catalog.SECTIONS):
        s = F.when(t.contains(word), name).otherwise(s)
    return F.last(F.when(F.col("kind") == "title", s), ignorenulls=True).over(_order())


def sections(nodes: DataFrame) -> DataFrame:
    """Tables with the section of the latest title that names one; tables before any such title go."""
    return nodes.withColumn("section", _section()).where("kind = 'table' and section is not null")


def labels(rows: Column) -> Column:
    return F.transform(rows, lambda r: text.label(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))


def classify(rows: Column) -> Column:
    """BS or IS by the labels of a table without a title, else unknown."""
    among = lambda words: F.arrays_overlap(labels(rows), F.array(*map(F.lit, words)))
    return F.when(among(catalog.BS_WORDS), "BS").when(among(catalog.IS_WORDS), "IS").otherwise("unknown")


def statement_tables(nodes: DataFrame) -> DataFrame:
    """sections(); where titles give a document neither BS nor IS, its tables by their labels as well. Nodes are gone
    through once, so they are made, and sorted, once."""
    known = F.bool_or((F.col("kind") == "table") & F.coalesce(F.col("section").isin("BS", "IS"), F.lit(False))).over(Window.partitionBy(*KEYS))
    tables = nodes.withColumn("section", _section()).withColumn("_known", known).where("kind = 'table'")
    by_labels = F.when(~F.col("_known"), F.nullif(classify(F.col("rows")), F.lit("unknown")))
    return tables.withColumn("section", F.explode(F.array_compact(F.array("section", by_labels)))).drop("_known")


def _cells(row: Column) -> Column:
    return F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))


def meaningful(rows: Column) -> Column:
    """A total row has an amount that is not 0."""
    total = lambda r: F.array_contains(F.array(*map(F.lit, catalog.TOTALS)), text.label(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
    return F.exists(rows, lambda r: total(r) & F.exists(_cells(r), lambda c: F.coalesce(amounts.cell_amount(c) != 0, F.lit(False))))


def division(nodes: DataFrame, report_type: Column | None = None) -> DataFrame:
    """keys, fs_div, scope: CFS where a consolidated statement holds amounts, unless the report's type says;
    scope is true or false where all statement titles agree, else null."""
    t = text.title(F.col("title_text"))
    statement = text.contains_any(t, [*catalog.STATEMENT_TITLES, "재무제표"])
    inside = F.last(F.when((F.col("kind") == "title") & statement, t.contains("연결")), ignorenulls=True).over(_order())
    scoped = (F.col("kind") == "title") & text.contains_any(t, catalog.SCOPE_TITLES)
    each = nodes.select(*KEYS, (F.coalesce(inside, F.lit(False)) & (F.col("kind") == "table") & F.coalesce(meaningful(F.col("rows")), F.lit(False))).alias("full"), (scoped & t.contains("연결")).alias("con"), (scoped & ~t.contains("연결")).alias("sep"))
    some = each.groupBy(*KEYS).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("full", "con", "sep")))
    by_data = F.when(F.col("full"), "CFS").otherwise("OFS")
    said = by_data if report_type is None else F.when(report_type == "audit_consol", "CFS").when(report_type == "audit_separate", "OFS").otherwise(by_data)
    scope = F.when(F.col("con") & ~F.col("sep"), True).when(F.col("sep") & ~F.col("con"), False)
    return some.select(*KEYS, said.alias("fs_div"), scope.alias("scope"))


def with_current_column(tables: DataFrame, with_total: bool = False) -> DataFrame:
    """Adds ``cur``, the column of the current period, null if the first five rows don't tell.

    The first cell with 당기 and not 전기, or below it a 합계 or 총계 column before the next 전기; else the
    highest 제 N 기; else the latest year 20xx; with_total: else the first 합계 or 총계. The cells of the head
    are one column, and what is read from them others, so that each is computed once for a table.
    """
    flat = lambda c: text.trim(text.nospace(c))
    named, lit = F.named_struct, F.lit
    cells = F.flatten(F.transform(F.slice("rows", 1, 5), lambda r, i: F.transform(r, lambda c, j: named(lit("i"), i, lit("j"), j, lit("c"), c, lit("f"), flat(c), lit("n"), F.size(r)))))
    out = tables.withColumn("_cells", cells).withColumn("_width", F.array_max(F.transform("rows", F.size)))
    past = lambda x: x["f"].contains("전기")
    total = lambda x: x["f"].isin("합계", "총계")
    first = lambda c: F.get(c, lit(0))
    out = out.withColumn("_now", first(F.filter("_cells", lambda x: x["f"].contains("당기") & ~past(x))))
    out = out.withColumn("_end", F.coalesce(first(F.filter("_cells", lambda x: (x["i"] == F.col("_now.i")) & (x["j"] > F.col("_now.j")) & past(x)))["j"], F.col("_now.n")))
    below = first(F.filter("_cells", lambda x: total(x) & (x["j"] > F.col("_now.j")) & ((x["n"] > F.col("_now.n")) | (x["j"] < F.col("_end")))))
    number = lambda x, pattern: named(lit("n"), F.regexp_extract(x["c"], pattern, 1).cast("decimal(38,0)"), lit("j"), -x["j"])
    term = rf"제{text.WS}*([0-9]+){text.WS}*기"
    out = out.withColumns({
        "_below": below,
        "_term": F.array_max(F.transform(F.filter("_cells", lambda x: x["c"].rlike(term)), lambda x: number(x, term))),
        "_year": F.array_max(F.flatten(F.transform("_cells", lambda x: F.transform(F.regexp_extract_all(x["c"], lit("(20[0-9]{2})"), lit(1)), lambda y: named(lit("n"), y.cast("int"), lit("j"), -x["j"]))))),
        "_total": first(F.filter("_cells", total)),
    })
    inside = F.coalesce(F.col("_below.j") + F.greatest(F.col("_width") - F.col("_below.n"), lit(0)), F.col("_now.j"))
    cur = F.coalesce(F.when(F.col("_now").isNotNull(), inside), -F.col("_term.j"), -F.col("_year.j"), *([F.col("_total.j")] if with_total else []))
    return out.withColumn("cur", cur).drop("_cells", "_width", "_now", "_end", "_below", "_term", "_year", "_total")


def column_label(rows: Column, at: Column) -> Column:
    """Distinct texts of a column's first five rows, joined by slashes."""
    texts = F.transform(F.slice(rows, 1, 5), lambda r: text.trim(F.regexp_replace(F.coalesce(F.get(r, at), F.lit("")), f"{text.WS}+", " ")))
    kept = F.array_distinct(F.filter(texts, lambda c: (c != "") & amounts.cell_amount(c).isNull()))
    return F.when(F.size(kept) > 0, F.array_join(kept, " / "))


ORIGIN = ("statement", "table_no", "normalized_label", "column_label", "unit_confidence", "raw_value", "known", "numeric", "forced", "turned")


def extract(tables: DataFrame, catalogue: DataFrame, origin: bool = False) -> DataFrame:
    """keys, item, value, confidence, unit, table_pos, row_id, row_label, column_id; with ``origin`` also statement,
    table_no (from 1, in the statement's section), normalized_label, column_label, unit_confidence, raw_value (the
    cell's text), and whether the current column was ``known``, the cell ``numeric``, the sign made ``forced``
    (positive) or ``turned``.

    tables: sections() with unit and unit_confidence. Tables and rows in order, the first whose label is a
    keyword of an item of the section and that has a value. In the current column, if known and there, a
    text counts as 0; else the first number outside note columns. Costs of sales are made positive.
    """
    before = []
    if origin:  # what a column is called is found once for a table, for all of its columns
        tables = tables.withColumn("table_no", F.row_number().over(Window.partitionBy(*KEYS, "section").orderBy("pos")))
        columns = F.sequence(F.lit(0), F.greatest(F.array_max(F.transform("rows", F.size)) - 1, F.lit(0)))
        tables = tables.withColumn("column_labels", F.transform(columns, lambda j: column_label(F.col("rows"), j)))
        before = ["table_no", "column_labels"]
    tables = tables.join(F.broadcast(catalogue.select(F.col("statement").alias("section")).distinct()), "section", "left_semi")  # no row of others can match
    seen = with_current_column(tables).select(*KEYS, *before, "pos", "section", "unit", "unit_confidence", "cur", F.transform(F.get("rows", F.lit(0)), lambda c: F.regexp_replace(c, f"{text.WS}+", "").contains("주석")).alias("notes"), F.posexplode("rows").alias("row_id", "row"))
    named = seen.withColumn("label", text.label(F.coalesce(F.get("row", F.lit(0)), F.lit(""))))
    words = catalogue.select("item", F.col("statement").alias("section"), "negated", F.explode("keywords").alias("label"))
    hit = named.join(F.broadcast(words), ["section", "label"]).withColumn("here", amounts.cell_amount(F.get("row", F.col("cur"))))
    known = F.col("cur").isNotNull() & (F.col("cur") < F.size("row"))
    numbers = F.filter(F.transform("row", lambda c, j: F.named_struct(F.lit("v"), amounts.cell_amount(c), F.lit("j"), j)), lambda x: (x["j"] > 0) & x["v"].isNotNull() & ~F.coalesce(F.get("notes", x["j"]), F.lit(False)))
    hit = hit.withColumn("first", F.when(~known, F.get(numbers, F.lit(0))))
    first = F.col("first")
    value = F.when(known, F.coalesce("here", F.lit(0.0))).otherwise(first["v"]) * F.col("unit")
    forced = (F.col("item") == "cogs") & (value < 0)
    value = F.when(forced, -value).otherwise(value)
    turned = F.array_contains("negated", F.col("label")) & (value > 0)
    value = F.when(turned, -value).otherwise(value)
    sure = known & F.col("here").isNotNull() & (F.col("unit_confidence") != "assumed_won")
    column = F.when(known, F.col("cur")).otherwise(first["j"])
    fields = [
        F.col("section").alias("statement"), F.col("table_no"), F.col("label").alias("normalized_label"), F.get("column_labels", column).alias("column_label"), F.col("unit_confidence"), F.get("row", column).alias("raw_value"),
        known.alias("known"), F.when(known, F.col("here").isNotNull()).otherwise(True).alias("numeric"), forced.alias("forced"), turned.alias("turned"),
    ] if origin else []
    out = hit.select(*KEYS, "item", "pos", "row_id", value.alias("value"), F.when(sure, "verified").otherwise("low_confidence").alias("confidence"), "unit", F.get("row", F.lit(0)).alias("row_label"), column.alias("column_id"), *fields)
    best = out.where("value is not null").groupBy(*KEYS, "item").agg(F.min_by(F.struct("value", "confidence", "unit", F.col("pos").alias("table_pos"), "row_id", "row_label", "column_id", *(c for c in out.columns if c in ORIGIN)), F.struct("pos", "row_id")).alias("m"))
    return best.select(*KEYS, "item", "m.*")


def with_units(tables: DataFrame) -> DataFrame:
    columns = tables.columns
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in columns else F.array().cast("array<string>")
    u = units.of_table(texts("prev_texts"), texts("parent_prev_texts"), texts("head_tr_texts"), F.col("rows"))
    return tables.withColumn("_u", u).select(*columns, "_u.unit", "_u.unit_confidence")


def text_bundle(nodes: DataFrame, most: int = 8000) -> DataFrame:
    """keys and one text: tables of BS, IS and CF with their unit, a line for each row that has a label and
    values, cut at ``most`` characters."""
    t = with_units(statement_tables(nodes).where("section in ('BS', 'IS', 'CF')"))
    inside = F.coalesce(units.first_in(F.flatten(F.slice("rows", 1, 5))), F.lit(1)).cast("bigint")
    unit = F.when(F.col("unit") == 1, inside).otherwise(F.col("unit"))
    name = F.transform("rows", lambda r: text.label(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
    values = F.transform("rows", lambda r: F.array_join(F.filter(_cells(r), lambda c: text.trim(c) != ""), " | "))
    line = F.filter(F.zip_with(name, values, lambda n, v: F.when((n != "") & (v != ""), F.concat(n, F.lit(": "), v))), lambda x: x.isNotNull())
    head = F.concat(F.lit("["), "section", F.lit("] (단위: "), units.name(unit), F.lit(")"))
    order = F.array_position(F.array(F.lit("BS"), F.lit("IS"), F.lit("CF")), F.col("section"))
    block = t.select(*KEYS, F.struct(order.alias("order"), "pos", F.array_join(F.concat(F.array(head), line), "\n").alias("block")).alias("b"))
    whole = block.groupBy(*KEYS).agg(F.sort_array(F.collect_list("b")).alias("b"))
    return whole.select(*KEYS, F.left(F.array_join(F.col("b.block"), "\n"), F.lit(most)).alias("text"))


def merged_members(nodes: DataFrame) -> DataFrame:
    """Nodes of all documents of an archive as those of one: ``pos`` goes on from member to member (``member``: 0 the
    largest file). Only archives of several members."""
    w = Window.partitionBy(*KEYS)
    several = nodes.withColumn("_most", F.max("member").over(w)).where("_most > 0")
    at = (F.row_number().over(w.orderBy("member", "pos")) - 1).cast("int")
    return several.withColumn("pos", at).drop("_most", "member")
