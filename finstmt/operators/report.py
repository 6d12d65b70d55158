"""Summaries, pivots, metrics and texts of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, catalog
from . import trace

SHOWN = [n for n in catalog.NAMES if n != "amort"] + ["amort"]


def division_name(path: Column, fs_div: Column, report_type: Column) -> Column:
    """연결 or 별도, by the account rows' division or by the report's type."""
    a = F.when(fs_div == "CFS", "연결").otherwise("별도")
    b = F.when(report_type == "audit_consol", "연결").when(report_type == "audit_separate", "별도").otherwise(a)
    return F.when(path == "A", a).when(path == "B", b).otherwise("-")


def status(state: Column, message: Column, is_valid: Column) -> Column:
    return F.when(state != "ok", message).when(is_valid.isNull(), "검증정보 없음").when(is_valid, "✓ 통과").otherwise("✗ 검증실패")


def detail(state: Column, message: Column, flags: Column) -> Column:
    lines = F.when(F.size(flags) == 0, F.array(F.lit("실패한 검증은 없습니다."))).otherwise(flags)
    return F.when(state != "ok", message).otherwise(F.array_join(lines, " | "))


# What stands for a missing message, and what follows a message (by state and a part of it, the first that fits).
MESSAGES = {"no_corp": "기업명을 찾지 못했습니다.", "ambiguous_corp": "동일 기업명이 여러 개 존재합니다.", "error": "분석 중 오류가 발생했습니다."}
NO_MESSAGE = "상세 사유 정보가 없습니다."
ENDINGS = [
    ("no_corp", "유사:", ". 입력한 이름과 정확히 일치하는 DART 기업명이 없어 자동 선택하지 않았습니다. 동명이인이나 유사 상호가 많을 수 있으니 정식 법인명으로 다시 조회해 주세요."),
    ("no_corp", "", ". DART 기업코드 목록에서 정확 일치 기업명을 찾지 못했습니다."),
    ("ambiguous_corp", "", " DART에 같은 이름의 법인이 다수 등록되어 있어 재무데이터를 특정할 수 없습니다."),
    ("error", "보고서 탐색 오류", ". DART 공시 목록 조회 단계에서 실패했습니다."),
    ("error", "재무데이터 추출 오류", ". 보고서는 찾았지만 재무 항목 추출 단계에서 실패했습니다."),
    ("error", "document.xml 다운로드 실패", ". 감사보고서 원문(document.xml)을 내려받지 못했습니다."),
]
NO_REPORT = " 사업연도 기준 사업보고서, 연결감사보고서, 감사보고서를 순서대로 찾았지만 사용 가능한 보고서를 찾지 못했습니다."


def processing(state: Column, message: Column, report_nm: Column, path: Column, division: Column, year: Column) -> Column:
    """What became of a company and year, in words; empty messages are missing ones."""
    said = F.nullif(message, F.lit(""))
    for s, m in MESSAGES.items():
        said = F.coalesce(said, F.when(state == s, m))
    said = F.coalesce(said, F.lit(NO_MESSAGE))
    good = F.concat(F.lit("데이터 추출 성공. 사용 보고서: "), F.coalesce(F.nullif(report_nm, F.lit("")), F.lit("-")), F.lit(", 경로 "), F.coalesce(path, F.lit("-")), F.lit(", 재무제표 기준 "), division, F.lit("."))
    out = F.when(state == "ok", good).when(state == "no_report", F.concat(year.cast("string"), F.lit(NO_REPORT)))
    for s, part, ending in ENDINGS:
        out = out.when((state == s) & said.contains(part), F.concat(said, F.lit(ending)))
    return out.otherwise(said)


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, every item and EBITDA as text in 억, status and detail; rows that came to nothing, by their ``state`` and
    ``message`` where results have these, say why."""
    shown = [amounts.hundred_millions(F.col(c)).alias(c) for c in [*catalog.NAMES, "ebitda"]]
    told = lambda c, otherwise: F.coalesce(c, F.lit(otherwise)) if c in results.columns else F.lit(otherwise)
    state, message = told("state", "ok"), told("message", "")
    return results.select(*keys, *shown, status(state, message, F.col("is_valid")).alias("status"), detail(state, message, F.col("flags")).alias("detail"))


def pivot_years(items: DataFrame, years: list[int]) -> DataFrame:
    """A company's items by year."""
    return items.groupBy("corp", "item").pivot("year", years).agg(F.first("value"))


def metrics(results: DataFrame) -> DataFrame:
    """Counts of a run: rows, items found, valid and invalid. Skipped checks count as passed."""
    found = sum((F.col(c).isNotNull().cast("int") for c in catalog.NAMES[1:]), F.col(catalog.NAMES[0]).isNotNull().cast("int"))
    return results.agg(F.count("*").alias("n_total"), F.sum(found).alias("n_items"), F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"))


def write_report(results: DataFrame, keys: list[str], root: str) -> None:
    """The summary as CSV and the raw results as Parquet, by many tasks into folders."""
    summary(results, keys).write.mode("overwrite").option("header", True).csv(f"{root}/summary")
    results.write.mode("overwrite").parquet(f"{root}/results")


def write_trace(events: DataFrame, root: str) -> dict[str, int]:
    """Lines of trace.events() as one text file for each company and year, and how many events of each tag there were."""
    seen, counts = trace.counted(events)
    spread = trace.lines(seen).repartition("corp", "year").sortWithinPartitions("corp", "year", "pos")
    spread.select("corp", "year", F.col("line").alias("value")).write.mode("overwrite").partitionBy("corp", "year").text(root)
    return counts.get
