"""The ordered log of a depreciation evaluation, made from what its stages have settled.

Every step gives tagged events (keys, stage, sub, tag, text); one window over a filing's events numbers its lines. A
filing has some ten events and one for each candidate table, and filings are many, so no key grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.settled import large
from . import depreciation
from .analysis import AMOUNTS, KEYS, Stages, result_of

# Names of the amounts in lines.
NAMES = {"depr": "감가상각비", "rou": "사용권자산상각비", "amort": "무형자산상각비"}
#: Order of the steps; those of a second pass follow those of the first.
START, LOAD, CF, NOTES, TABLES, RETRY, CF_AGAIN, NOTES_AGAIN, TABLES_AGAIN, CHOICE, FINAL = range(11)


def shown(c: Column) -> Column:
    """A number with its decimals, None where there is none."""
    whole = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when(c.isNull(), "None").when(c == F.floor(c), whole).otherwise(c.cast("string"))


def told(c: Column) -> Column:
    return F.when(c.isNull(), "None").when(c, "True").otherwise("False")


def _amounts(prefix: str = "") -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{NAMES[a]}="), shown(F.col(prefix + a))) for a in AMOUNTS))


def _event(rows: DataFrame, stage: int, tag: str, line: Column, sub: Column | int = 0) -> DataFrame:
    sub = F.lit(sub) if isinstance(sub, int) else sub
    return rows.select(*KEYS, F.lit(stage).alias("stage"), sub.cast("int").alias("sub"), F.lit(tag).alias("tag"), line.alias("text"))


def _cash_flow(documents: DataFrame, cash_flow: DataFrame, stage: int) -> DataFrame:
    both = documents.select(*KEYS).join(large(cash_flow), KEYS, "left").withColumn("combined", F.coalesce("combined", F.lit(False)))
    return _event(both, stage, "CF", F.concat(F.lit("Python 추출 결과: "), _amounts(), F.lit(", combined="), told(F.col("combined"))))


def _tables(documents: DataFrame, candidates: DataFrame, stage: int, tag: str, said: str) -> DataFrame:
    """How many candidates there are, and a line for each with what it states, its section and its first labels."""
    n = documents.select(*KEYS).join(large(candidates.groupBy(*KEYS).agg(F.count("*").alias("n"))), KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    count = _event(n, stage, tag, F.concat(F.lit(f"{said} "), F.col("n").cast("string"), F.lit("개")))
    s = depreciation.signals(F.col("rows"))
    marks = F.concat_ws("/", F.when(s["pair"], "SEPARATE_PAIR").when(s["exact"], "depr"), F.when(s["combined"], "COMBINED"))
    title = depreciation.section_title(F.coalesce("prev_texts", F.array().cast("array<string>")))
    labels = F.array_join(F.transform(F.slice("rows", 1, 5), lambda r: text.trim(F.coalesce(F.get(r, F.lit(0)), F.lit("")))), ", ")
    line = F.concat(F.lit("T"), F.col("table_no").cast("string"), F.lit(" "), F.when(marks == "", "").otherwise(F.concat(F.lit("["), marks, F.lit("] "))), F.lit("title="), F.when(title == "", "-").otherwise(title), F.lit(" / labels="), labels)
    return count.unionByName(_event(candidates, stage + 1, "NOTES", line, F.col("table_no")))


def events(found: Stages, strict: bool, selection: DataFrame | None = None) -> DataFrame:
    """keys, stage, sub, tag, text of every filing's evaluation."""
    docs, cf = found.documents, found.cash_flow
    done = F.col("depr").isNotNull() & (F.col("amort").isNotNull() | F.coalesce("combined", F.lit(False)))
    complete = cf.where(done).select(*KEYS)
    open_ = docs.join(large(complete), KEYS, "left_anti")
    out = _event(docs, START, "START", F.concat(F.lit("fs_div="), "fs_div", F.lit(f", strict_scope={strict}")))
    out = out.unionByName(_event(docs, LOAD, "LOAD", F.concat(F.lit("document_scope="), told(F.col("scope")))))
    out = out.unionByName(_cash_flow(docs, cf, CF))
    out = out.unionByName(_tables(open_, found.candidates.join(large(complete), KEYS, "left_anti"), NOTES, "NOTES", "후보 테이블"))
    results = result_of(found, selection)
    again = found.again
    if again is not None:
        ended = found.cash_flow_again.where(done).select(*KEYS)
        out = out.unionByName(_event(again, RETRY, "RETRY", F.concat(F.lit("최대 파일에서 결과 없음, 병합 재시도, document_scope="), told(F.col("scope")))))
        out = out.unionByName(_cash_flow(again, found.cash_flow_again, CF_AGAIN))
        out = out.unionByName(_tables(again.join(large(ended), KEYS, "left_anti"), found.candidates_again.join(large(ended), KEYS, "left_anti"), NOTES_AGAIN, "RETRY", "병합 파일에서 후보 테이블"))
    if selection is not None:
        _, candidates = found.accepted()
        looked = selection.join(large(candidates.select(*KEYS).distinct().join(large(complete), KEYS, "left_anti")), KEYS, "left_semi")
        place = F.concat("slot", F.lit("=T"), F.col("table_no").cast("string"), F.lit("/R"), F.col("row_no").cast("string"))
        order = F.array_position(F.array(*map(F.lit, AMOUNTS)), F.col("slot"))
        asked = looked.groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list(F.struct(order.alias("o"), place.alias("p"))))["p"], ", ").alias("p"))
        out = out.unionByName(_event(asked, CHOICE, "NOTES", F.concat(F.lit("AI 선택 결과: "), "p")))
    end = docs.select(*KEYS).join(large(results), KEYS, "left").withColumns({"source": F.coalesce("source", F.lit("error")), "combined": F.coalesce("combined", F.lit(False))})
    return out.unionByName(_event(end, FINAL, "FINAL", F.concat(F.lit("source="), "source", F.lit(", combined="), told(F.col("combined")), F.lit(", "), _amounts())))


def lines(of: DataFrame) -> DataFrame:
    """keys, pos (from 1), line of events()."""
    order = Window.partitionBy(*KEYS).orderBy("stage", "sub")
    return of.select(*KEYS, F.row_number().over(order).alias("pos"), F.concat(F.lit("["), "tag", F.lit("] "), "text").alias("line"))


def counted(of: DataFrame) -> tuple[DataFrame, Observation]:
    """events() and, once an action has run over them, how many there were: in all and by tag."""
    seen = Observation("trace")
    by_tag = [F.count_if(F.col("tag") == t).alias(t) for t in ("START", "LOAD", "CF", "NOTES", "RETRY", "FINAL")]
    return of.observe(seen, F.count("*").alias("events"), *by_tag), seen
