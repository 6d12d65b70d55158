"""Readers of landed responses: registry, filings, account rows, company details, document index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

REGISTRY = ["corp_code", "corp_name", "stock_code", "modify_date"]
ACCOUNT = "account_id string, account_nm string, sj_div string, fs_div string, thstrm_nm string, thstrm_amount string, frmtrm_amount string, currency string, ord string"
FILING = "rcept_no string, report_nm string, rcept_dt string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The company registry from XML (one <list> a company), trimmed, with ``pos`` in file order."""
    rows = spark.read.format("xml").option("rowTag", "list").schema(", ".join(f"{c} string" for c in REGISTRY)).load(path)
    return rows.select(F.monotonically_increasing_id().alias("pos"), *(text.trim(F.coalesce(c, F.lit(""))).alias(c) for c in REGISTRY))


def snapshot(rows: DataFrame, path: str) -> None:
    """A registry snapshot with the time it was taken."""
    rows.withColumn("taken_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def fresh(spark: SparkSession, path: str, hours: int = 24) -> DataFrame:
    """The snapshot's rows if it is younger than ``hours``, else none."""
    return spark.read.parquet(path).where(F.col("taken_at") > F.current_timestamp() - F.expr(f"interval {int(hours)} hours")).drop("taken_at")


def _listed(spark: SparkSession, path: str, kind: str, keys: str, lines: bool) -> DataFrame:
    """Rows of the lists of landed responses: a file each, or (``lines``) a line each, which many tasks can share."""
    rows = spark.read.schema(f"status string, {keys}, list array<struct<{', '.join(c.replace(' ', ':', 1) for c in kind.split(', '))}>>").option("multiLine", not lines).json(path)
    names = [k.split()[0] for k in keys.split(", ")]
    return rows.where("coalesce(status, '000') = '000'").select(*names, F.posexplode("list").alias("pos", "r")).select(*names, "pos", "r.*")


def account_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Account rows in the order of their response; responses that are not 000 have none."""
    return _listed(spark, path, ACCOUNT, "corp string, year int", lines)


def filings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _listed(spark, path, FILING, "corp string, kind string", lines)


def company_info(spark: SparkSession, path: str) -> DataFrame:
    fields = ["corp_code", "corp_cls", "ceo_nm", "adres", "induty_code", "est_dt"]
    rows = spark.read.schema(", ".join(f"{c} string" for c in ["status", *fields])).json(path)
    return rows.where("status = '000'").select(*fields)


def statement_document(index: DataFrame) -> DataFrame:
    """Of each filing's documents (rcept_no, pos, title, url) the first titled as a statement, else as an
    audit report, else the first."""
    p = F.when(text.contains_any(F.col("title"), ["재무제표", "재무상태표", "손익계산서"]), 0).when(F.col("title").contains("감사보고서"), 1).otherwise(2)
    return index.groupBy("rcept_no").agg(F.min_by("url", F.struct(p, "pos")).alias("url"))
