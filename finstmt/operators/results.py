"""From items to a checked result: merge of depreciation, EBITDA, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..sources.settled import large

# Names of the rules.
BALANCE, GROSS, OPERATING = "회계항등식: 총자산 = 총부채 + 자본총계", "회계항등식: 매출총이익 = 매출액 - 매출원가", "논리검증: 영업이익 ≤ 매출총이익"


def wide(items: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key with a column for each of the twelve items."""
    return items.groupBy(*keys).pivot("item", catalog.NAMES).agg(F.first("value"))


def overlay(items: DataFrame, depreciation: DataFrame, keys: list[str]) -> DataFrame:
    """Depreciation values (depr, rou, amort, combined) replace those of the statement where they are set.

    A combined amount stands in depr; the other two are then null and ``remarks`` says so. Where depreciation has a
    ``source`` it is kept as depr_source.
    """
    d = depreciation.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("depr", "rou", "amort")), F.col("combined").alias("_combined"), *(F.col(c).alias("depr_source") for c in depreciation.columns if c == "source"))
    both = items.join(large(d), keys, "left")
    combined = F.coalesce("_combined", F.lit(False))
    put = {c: F.coalesce(f"_{c}", c) for c in ("depr", "rou", "amort")}
    put |= {c: F.when(~combined, put[c]) for c in ("rou", "amort")}
    note = F.when(combined, F.lit("감가상각비란에 '감가상각비 및 무형자산상각비' 합산액 기입 (원본에서 분리 불가)"))
    return both.select(*keys, *(put.get(c, F.col(c)).alias(c) for c in items.columns if c not in keys), note.alias("remarks"), *(c for c in d.columns if c == "depr_source"))


def positive_costs(items: DataFrame) -> DataFrame:
    """Costs given as negative numbers become positive; ``turned`` names them."""
    turned = F.filter(F.array(*(F.when(F.col(c) < 0, F.lit(c)) for c in catalog.COSTS)), lambda x: x.isNotNull())
    return items.withColumns({"turned": turned, **{c: F.abs(c) for c in catalog.COSTS}})


def ebitda() -> Column:
    """Operating income with the three add-backs; null without operating income."""
    zero = F.lit(0.0)
    return F.col("op_income") + F.coalesce("depr", zero) + F.coalesce("rou", zero) + F.coalesce("amort", zero)


def _check(rule: str, severity: str, needed: list[str], actual: Column, expected: Column, diff: Column, passed: Column) -> Column:
    missing = F.coalesce(F.greatest(*(F.col(c).isNull() for c in needed)), F.lit(True))
    there = lambda c: F.when(~missing, c)
    return F.struct(
        F.lit(rule).alias("rule"), there(expected).cast("double").alias("expected"), there(actual).alias("actual"), there(diff).alias("diff"),
        (missing | passed).alias("passed"), F.when(missing, "info").otherwise(severity).alias("severity"), F.when(missing, F.lit("missing items")).alias("note"),
    )


def checks() -> Column:
    """The three identity checks as an array of structs. A check that lacks an item passes."""
    c = F.col
    close = lambda d, base: F.abs(d) <= F.greatest(F.lit(1.0), F.abs(base) * 0.0001)
    sum_, margin = c("liabilities") + c("equity"), c("revenue") - c("cogs")
    return F.array(
        _check(BALANCE, "critical", ["assets", "liabilities", "equity"], c("assets"), sum_, F.abs(c("assets") - sum_), close(c("assets") - sum_, c("assets"))),
        _check(GROSS, "critical", ["gross", "revenue", "cogs"], c("gross"), margin, F.abs(c("gross") - margin), close(c("gross") - margin, F.when(c("gross") != 0, c("gross")).otherwise(margin))),
        _check(OPERATING, "warning", ["op_income", "gross"], c("op_income"), c("gross"), F.greatest(c("op_income") - c("gross"), F.lit(0.0)), c("op_income") <= c("gross")),
    )


def flag(check: Column) -> Column:
    return F.concat(F.lit("["), F.upper(check["severity"]), F.lit("] "), check["rule"], F.when(check["diff"].isNotNull(), F.concat(F.lit(" | 차이="), F.format_number(check["diff"], 0), F.lit("원"))).otherwise(F.lit("")))


def validated(items: DataFrame) -> DataFrame:
    """Adds checks, is_valid (no critical failure) and flags (failed checks)."""
    out = items.withColumn("checks", checks())
    return out.withColumns({
        "is_valid": ~F.exists("checks", lambda k: ~k["passed"] & (k["severity"] == "critical")),
        "flags": F.transform(F.filter("checks", lambda k: ~k["passed"]), flag),
    })
