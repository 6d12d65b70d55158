"""Depreciation from cash-flow statements and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, catalog, text, units
from ..sources.settled import large
from .documents import KEYS, with_current_column


def _window(before: bool = False) -> Window:
    return Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if before else 0)


def is_general(label: Column) -> Column:
    return label.contains("감가상각") & ~text.contains_any(label, ["누계", "사용권", "무형자산상각"])


def row_value(row: Column, cur: Column) -> Column:
    """The current cell, or the first number outside the label where it is none."""
    now = F.when(cur < F.size(row), amounts.note_amount(F.get(row, cur)))
    return F.coalesce(now, F.get(F.filter(F.transform(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), amounts.note_amount), lambda v: v.isNotNull()), F.lit(0)))


def cash_flow_tables(nodes: DataFrame, divisions: DataFrame, strict: bool) -> DataFrame:
    """Tables of cash-flow statements: tables under such a title, or outside the notes with its contents.

    Whether a node lies in the notes depends on the latest root title only, the rest on the latest title.
    divisions: keys, fs_div, scope. strict: only the division's own tables, unless there is none.
    """
    title, core = F.col("kind") == "title", text.title_core(F.col("title_text"))
    notes, root = core.isin(*catalog.NOTES_ROOTS), core.isin(*catalog.STATEMENT_ROOTS)
    d = nodes.join(large(divisions), KEYS, "left")
    in_notes = F.coalesce(F.last(F.when(title & notes, True).when(title & root, False), ignorenulls=True).over(_window()), F.lit(False))
    d = d.withColumn("in_notes", in_notes)
    is_cf = F.when(notes, False).when(root, core.contains("현금흐름표")).when(F.col("in_notes"), False).otherwise(text.title(F.col("title_text")).contains("현금흐름표"))
    scope = F.when(is_cf, F.when(core.contains("연결"), True).when(core.contains("별도"), False).otherwise(F.coalesce("scope", F.lit(False))))
    last = F.last(F.when(title, F.struct(is_cf.alias("cf"), scope.alias("of"))), ignorenulls=True).over(_window())
    looks = F.exists(F.slice("rows", 1, 10), lambda r: text.contains_any(text.trim(text.nospace(F.coalesce(F.get(r, F.lit(0)), F.lit("")))), catalog.CF_MARKERS))
    at = d.withColumn("t", last).where("kind = 'table'")
    cf = F.coalesce(F.col("t.cf"), F.lit(False))
    at = at.where((cf | ~F.col("in_notes")) & (cf | F.coalesce(looks, F.lit(False))))
    at = at.withColumn("matched", F.coalesce(F.col("t.of") == (F.col("fs_div") == "CFS"), F.lit(True)))
    if strict:
        at = at.withColumn("any", F.bool_or("matched").over(Window.partitionBy(*KEYS))).where("matched or not any").drop("any")
    return at.drop("t", "in_notes")


def labelled_rows(tables: DataFrame, with_total: bool = True) -> DataFrame:
    """A row for each table row: keys, pos, row_id, label, value (times unit)."""
    each = with_current_column(tables, with_total).select(*KEYS, "pos", "unit", "cur", F.posexplode("rows").alias("row_id", "row"))
    label = text.row_label(F.coalesce(F.get("row", F.lit(0)), F.lit("")))
    return each.select(*KEYS, "pos", "row_id", label.alias("label"), (row_value(F.col("row"), F.col("cur")) * F.col("unit")).alias("value"))


def cash_flow_buckets(tables: DataFrame) -> DataFrame:
    """keys, depr, rou, amort, combined from cash-flow tables (with unit) that speak of depreciation.

    The first combined and the first general row decide: if the combined one comes first its amount stands
    alone, else all general rows of the first one's table are added up.
    """
    about = tables.where(F.array_join(F.flatten("rows"), " ").contains("감가상각"))
    label = F.col("label")
    kind = F.when(label.contains("누계"), None).when(label.contains("감가상각") & label.contains("무형자산상각"), "combined").when(text.contains_any(label, ["사용권자산상각", "사용권자산감가상각"]), "rou").when(label.contains("무형자산상각"), "amort").when(label.contains("감가상각"), "general")
    rows = labelled_rows(about).withColumn("kind", kind).where("kind is not null and value is not null").withColumn("at", F.struct("pos", "row_id"))
    kinds = ("rou", "amort", "combined", "general")
    # First by table, then by filing, so that rows are read once: (at, value) of each kind's first row, and a table's general sum.
    first = [F.min(F.when(F.col("kind") == k, F.struct("at", "value"))).alias(k) for k in kinds]
    total = F.sum(F.when(F.col("kind") == "general", F.col("value").cast("decimal(38,4)"))).cast("double").alias("total")
    of_table = rows.groupBy(*KEYS, "pos").agg(*first, total)
    out = of_table.groupBy(*KEYS).agg(*(F.min(k).alias(k) for k in kinds), F.expr("min_by(total, pos) FILTER (WHERE general IS NOT NULL)").alias("total"))
    pc, pg = F.col("combined.at"), F.col("general.at")
    combined = pc.isNotNull() & (pg.isNull() | (pc < pg))
    return out.select(*KEYS, F.when(combined, F.col("combined.value")).otherwise(F.col("total")).alias("depr"), F.col("rou.value").alias("rou"), F.col("amort.value").alias("amort"), combined.alias("combined"))


def signals(rows: Column) -> Column:
    """(exact, amort, combined, pair): a row with a number that is exactly depreciation, exactly amortisation, or both
    in one; pair: the first two stand apart in one table."""
    num = lambda r: F.exists(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: amounts.note_amount(c).isNotNull())
    name = lambda r: text.row_label(F.coalesce(F.get(r, F.lit(0)), F.lit("")))
    both = lambda l: l.contains("감가상각비") & l.contains("무형자산상각비")  # noqa: E731, E741
    exact = F.exists(rows, lambda r: name(r).isin(*catalog.EXACT_DEPR) & num(r))
    amort = F.exists(rows, lambda r: name(r).isin(*catalog.EXACT_AMORT) & num(r))
    combined = F.exists(rows, lambda r: both(name(r)) & ~name(r).contains("누계") & num(r))
    return F.struct(exact.alias("exact"), amort.alias("amort"), combined.alias("combined"), (exact & amort).alias("pair"))


def separate_pairs(tables: DataFrame) -> DataFrame:
    """keys and the candidates (with table_no), as T1, T2, that state depreciation and amortisation in rows of their own."""
    name = F.struct("table_no", F.concat(F.lit("T"), F.col("table_no").cast("string")).alias("name"))
    found = tables.where(signals(F.col("rows"))["pair"]).groupBy(*KEYS).agg(F.sort_array(F.collect_list(name)).alias("t"))
    return found.select(*KEYS, F.array_join("t.name", ", ").alias("pairs"))


def section_title(previous: Column) -> Column:
    """The nearest text before a table that begins with a number."""
    found = F.transform(F.slice(previous, 1, 10), lambda t: F.regexp_extract(t, r"^([0-9]+\.?[\x09-\x0D\x20]*.{2,40})", 1))
    return F.coalesce(F.get(F.filter(found, lambda t: t != ""), F.lit(0)), F.lit(""))


def notes_scope(nodes: DataFrame, divisions: DataFrame, strict: bool) -> DataFrame:
    """Nodes with in_notes, scope_now (consolidated or not, null unknown) and has_scoped (the notes named a
    scope somewhere). The scope is carried from title to title, so titles are folded in order; a document's
    titles are one array, its tables are not."""
    core = text.title_core(F.col("title_text"))
    titles = nodes.where("kind = 'title'").select(*KEYS, F.struct("pos", core.alias("core")).alias("t"))
    per = titles.groupBy(*KEYS).agg(F.sort_array(F.collect_list("t")).alias("ts")).join(large(divisions), KEYS, "left")
    has = lambda words: F.exists("ts", lambda t: t["core"].isin(*words))
    con, sep = has(["연결재무제표주석", "연결주석"]), has(["별도재무제표주석", "별도주석"])
    per = per.withColumns({"con": con, "sep": sep})
    known = F.when(F.col("con") & ~F.col("sep"), False).when(F.col("sep") & ~F.col("con"), True)
    null = F.lit(None).cast("boolean")

    def step(a: Column, t: Column) -> Column:
        c, now = t["core"], a["scope"]
        either = F.coalesce(known, now, F.col("scope"))
        plain = F.lit(False) if strict else either
        new = F.when(c.isin("연결재무제표주석", "연결주석"), True).when(c.isin("별도재무제표주석", "별도주석"), False).when(c == "재무제표주석", plain).when(a["inside"], now).otherwise(either)
        notes, root = c.isin(*catalog.NOTES_ROOTS), c.isin(*catalog.STATEMENT_ROOTS)
        inside = F.when(notes, True).when(root, False).otherwise(a["inside"])
        scope = F.when(notes, new).when(root, null).otherwise(now)
        scoped = a["scoped"] | (notes & new.isNotNull())
        return F.struct(inside.alias("inside"), scope.alias("scope"), scoped.alias("scoped"), F.concat(a["out"], F.array(F.struct(t["pos"].alias("pos"), inside.alias("inside"), scope.alias("scope")))).alias("out"))

    zero = F.struct(F.lit(False).alias("inside"), null.alias("scope"), F.lit(False).alias("scoped"), F.array().cast("array<struct<pos:int,inside:boolean,scope:boolean>>").alias("out"))
    done = per.select(*KEYS, F.aggregate("ts", zero, step).alias("a"))
    spread = done.select(*KEYS, F.col("a.scoped").alias("has_scoped"), F.explode("a.out").alias("o")).select(*KEYS, "has_scoped", "o.*")
    both = nodes.join(large(spread.withColumnsRenamed({"inside": "_i", "scope": "_s", "has_scoped": "_h"})), [*KEYS, "pos"], "left")
    last = F.last(F.when(F.col("kind") == "title", F.struct("_i", "_s", "_h")), ignorenulls=True).over(_window())
    return both.withColumn("_l", last).select(*nodes.columns, F.coalesce(F.col("_l._i"), F.lit(False)).alias("in_notes"), F.col("_l._s").alias("scope_now"), F.coalesce(F.col("_l._h"), F.lit(False)).alias("has_scoped"))


def notes_candidates(nodes: DataFrame, divisions: DataFrame, strict: bool) -> DataFrame:
    """Tables of the notes that state the company's depreciation, with ``table_no`` from 1 in order.

    strict: those of the division's scope; else, where the document has that scope, those of none; else, if no
    notes title named a scope, those of none or all.
    """
    t = notes_scope(nodes, divisions, strict).where("kind = 'table' and in_notes")
    header = F.array_join(F.flatten(F.slice("rows", 1, 3)), " ")
    s = signals(F.col("rows"))
    t = t.where(F.array_join(F.flatten("rows"), " ").contains("감가상각") & ~text.contains_any(header, catalog.EXCLUDED_HEADERS) & (s["exact"] | s["combined"]) & ~text.contains_any(section_title(F.coalesce("prev_texts", F.array().cast("array<string>"))), catalog.PARTIAL_TITLES))
    if strict:
        w = Window.partitionBy(*KEYS)
        t = t.join(large(divisions), KEYS, "left").withColumn("want", F.col("fs_div") == "CFS")
        t = t.withColumns({"own": F.coalesce(F.col("scope_now") == F.col("want"), F.lit(False)), "open": F.col("scope_now").isNull()})
        t = t.withColumns({"any_own": F.bool_or("own").over(w), "any_open": F.bool_or("open").over(w)})
        same = F.coalesce(F.col("scope") == F.col("want"), F.lit(False))
        keep = F.when(F.col("any_own"), F.col("own")).when(same, F.col("open")).when(~F.col("has_scoped"), F.col("open") | ~F.col("any_open")).otherwise(False)
        t = t.where(keep).drop("want", "own", "open", "any_own", "any_open", "fs_div", "scope")
    return t.withColumn("table_no", F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")))


def selection_text(tables: DataFrame) -> DataFrame:
    """keys and one text: candidates (with unit and table_no) and their rows with the numbers to choose by."""
    title = section_title(F.coalesce("prev_texts", F.array().cast("array<string>")))
    head = F.array(F.concat(F.lit("[TABLE T"), F.col("table_no").cast("string"), F.lit("]")), F.concat(F.lit("[SECTION] "), F.when(title == "", "-").otherwise(title)), F.concat(F.lit("[UNIT] "), units.name(F.col("unit"))))
    lines = F.transform("rows", lambda r, i: F.concat(F.lit("[ROW R"), (i + 1).cast("string"), F.lit("] "), F.array_join(r, " | ")))
    block = tables.select(*KEYS, F.struct("table_no", F.array_join(F.concat(head, lines), "\n").alias("block")).alias("b"))
    return block.groupBy(*KEYS).agg(F.sort_array(F.collect_list("b")).alias("b")).select(*KEYS, F.array_join(F.col("b.block"), "\n\n").alias("text"))


def verify_selection(tables: DataFrame, selection: DataFrame) -> DataFrame:
    """keys, depr, rou, amort, combined of the positions that a model chose, if the labels there allow it.

    tables: candidates with unit and table_no; selection: keys, slot (depr, rou, amort), table_no, row_no (from
    1), combined. A combined row gives its own amount, exact depreciation the sum of its table's general rows.
    """
    rows = with_current_column(tables, True).select(*KEYS, "table_no", "unit", "cur", F.posexplode("rows").alias("row_no", "row")).withColumn("row_no", F.col("row_no") + 1)
    rows = rows.withColumn("label", text.row_label(F.coalesce(F.get("row", F.lit(0)), F.lit(""))))
    sums = rows.where(is_general(F.col("label"))).select(*KEYS, "table_no", (row_value(F.col("row"), F.col("cur")) * F.col("unit")).cast("decimal(38,4)").alias("v")).groupBy(*KEYS, "table_no").agg(F.sum("v").cast("double").alias("total"))
    here = F.when(F.col("cur") < F.size("row"), amounts.note_amount(F.get("row", F.col("cur")))).otherwise(F.get(F.filter(F.transform(F.slice("row", 2, F.greatest(F.size("row") - 1, F.lit(0))), amounts.note_amount), lambda v: v.isNotNull()), F.lit(0)))
    here = F.when(F.col("cur").isNull(), row_value(F.col("row"), F.lit(None).cast("int"))).otherwise(here) * F.col("unit")
    at = selection.join(large(rows.select(*KEYS, "table_no", "row_no", "label", here.alias("here"))), [*KEYS, "table_no", "row_no"], "left").join(large(sums), [*KEYS, "table_no"], "left")
    label = F.col("label")
    both = label.contains("감가상각비") & label.contains("무형자산상각비")
    value = (
        F.when((F.col("slot") == "depr") & both, F.col("here")).when((F.col("slot") == "depr") & label.isin(*catalog.EXACT_DEPR), F.coalesce("total", "here"))
        .when((F.col("slot") == "rou") & ~F.col("combined") & label.isin(*catalog.EXACT_ROU), F.col("here"))
        .when((F.col("slot") == "amort") & ~F.col("combined") & label.isin(*catalog.EXACT_AMORT), F.col("here"))
    )
    picked = at.select(*KEYS, "slot", "combined", value.alias("value"))
    return picked.groupBy(*KEYS).agg(*(F.expr(f"first(value) FILTER (WHERE slot = '{s}')").alias(s) for s in ("depr", "rou", "amort")), F.bool_or("combined").alias("combined"))


def merged(cash_flow: DataFrame, notes: DataFrame) -> DataFrame:
    """Cash-flow values first, then those of the notes; source says where they come from. Complete cash-flow
    results (depreciation with amortisation or combined) don't look at the notes."""
    n = notes.select(*KEYS, *(F.col(c).alias(f"n_{c}") for c in ("depr", "rou", "amort", "combined")))
    out = cash_flow.join(n, KEYS, "full")
    done = F.coalesce(F.col("depr").isNotNull() & (F.col("amort").isNotNull() | F.col("combined")), F.lit(False))
    pick = lambda c: F.when(done, F.col(c)).otherwise(F.coalesce(c, f"n_{c}"))
    has = lambda p: F.coalesce(*(F.col(f"{p}{c}") for c in ("depr", "rou", "amort"))).isNotNull()
    source = F.when(done | (has("") & ~has("n_")), "cf").when(has("") & has("n_"), "cf+notes").when(has("n_"), "notes").otherwise("error")
    combined = F.coalesce("combined", F.lit(False)) | (~done & F.coalesce("n_combined", F.lit(False)))
    return out.select(*KEYS, *(pick(c).alias(c) for c in ("depr", "rou", "amort")), combined.alias("combined"), source.alias("source"))
