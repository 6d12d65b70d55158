"""All companies and years at once: from names to checked results."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settled import large, settle
from . import accounts, depreciation, documents, resolve, results

KEYS = ["corp", "year"]
FALLBACK = "사업보고서 본문 파싱으로 추출 (XBRL 미등록)"
AMOUNTS = ("depr", "rou", "amort")


def _some() -> Column:
    return F.coalesce(*AMOUNTS).isNotNull()


def _complete() -> Column:
    return F.col("depr").isNotNull() & (F.col("amort").isNotNull() | F.coalesce("combined", F.lit(False)))


@dataclass
class Stages:
    """What the evaluation of depreciation found on its way, settled if there is a second pass. ``documents``: keys, fs_div, scope of every
    filing; ``again``: the same, with the scope of the merged members, of those that were evaluated once more."""

    documents: DataFrame
    cash_flow: DataFrame
    candidates: DataFrame
    again: DataFrame | None = None
    cash_flow_again: DataFrame | None = None
    candidates_again: DataFrame | None = None

    def accepted(self) -> tuple[DataFrame, DataFrame]:
        """(cash-flow amounts, candidates of the notes) that count. Of merged members a cash flow counts only if it is
        complete: depreciation with amortisation or combined; else their candidates do."""
        cf, candidates = self.cash_flow.where(_some()), self.candidates
        if self.again is not None:
            complete = self.cash_flow_again.where(_complete())
            cf = cf.unionByName(complete)
            candidates = candidates.unionByName(self.candidates_again.join(large(complete.select(*KEYS)), KEYS, "left_anti"))
        return cf, candidates


def _cash_flow(nodes: DataFrame, divisions: DataFrame, strict: bool) -> DataFrame:
    return depreciation.cash_flow_buckets(documents.with_units(depreciation.cash_flow_tables(nodes, divisions, strict)))


def _evaluated(nodes: DataFrame, divisions: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Cash-flow buckets and the candidates of the notes."""
    return _cash_flow(nodes, divisions, strict), documents.with_units(depreciation.notes_candidates(nodes, divisions, strict))


def stages(nodes: DataFrame, divisions: DataFrame, strict: bool, members: DataFrame | None = None) -> Stages:
    """Evaluate the first document of every filing (nodes; divisions: keys, fs_div, scope), and all members of an archive
    (documents.merged_members) as one document where the first gave neither an amount nor a candidate.

    The first pass is settled, so that the second is planned over, and reads, only the filings that failed. What a
    document's scope is, the second pass infers anew from all members.
    """
    cf, candidates = _evaluated(nodes, divisions.select(*KEYS, "fs_div", "scope"), strict)
    if members is None:
        return Stages(divisions.select(*KEYS, "fs_div", "scope"), cf, candidates)
    cf, candidates = settle(cf, "first-cash-flow"), settle(candidates, "first-notes")
    found = cf.where(_some()).select(*KEYS).union(candidates.select(*KEYS)).distinct()
    left = settle(members.join(large(found), KEYS, "left_anti").select(*nodes.columns), "again-nodes")
    again = divisions.select(*KEYS, "fs_div").join(large(documents.division(left).select(*KEYS, "scope")), KEYS)
    again = settle(again, "again-scope")
    return Stages(divisions.select(*KEYS, "fs_div", "scope"), cf, candidates, again, *(settle(d, f"again-{n}") for n, d in zip(("cash-flow", "notes"), _evaluated(left, again, strict), strict=True)))


def depreciation_of(nodes: DataFrame, divisions: DataFrame, strict: bool, selection: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """keys, depr, rou, amort, combined, source (cf, notes, cf+notes, error) of filings that gave an amount or a
    candidate; see stages(). Without a selection the notes give nothing."""
    if selection is None and members is None:  # nothing asks for the notes
        return _cash_flow(nodes, divisions.select(*KEYS, "fs_div", "scope"), strict).where(_some()).withColumn("source", F.lit("cf"))
    return result_of(stages(nodes, divisions, strict, members), selection)


def result_of(found: Stages, selection: DataFrame | None = None) -> DataFrame:
    cf, candidates = found.accepted()
    if selection is None:
        return cf.withColumn("source", F.lit("cf"))
    asked = selection.join(large(candidates.select(*KEYS).distinct()), KEYS, "left_semi")
    return depreciation.merged(cf, depreciation.verify_selection(candidates, asked))


def analyze(names: DataFrame, years: DataFrame, registry: DataFrame, filings: DataFrame, rows: DataFrame, nodes: DataFrame, catalogue: DataFrame, overrides: DataFrame | None = None, selection: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """name, year, corp, status (ok, no_corp, ambiguous_corp, no_report, error), path, fs_div, the items, EBITDA,
    checks, is_valid, flags and remarks.

    Each branch is settled by itself, so that no plan has the nodes of all of them: Spark plans what is left anew, and keeps
    its text, at the end of every stage.

    names (name) meet every year; rows are account rows, nodes document nodes, both by corp and year. A filing
    of type A001 is path A: account rows, or, where it has none, its document; others are path B. Without a
    selection relation the notes give nothing. members: nodes of whole archives, see depreciation_of(); depr_source says
    whether depreciation comes from the cash flow, the notes or both.
    """
    grid = resolve.resolve(names, registry, overrides).crossJoin(F.broadcast(years)).withColumnRenamed("corp_code", "corp")
    grid = settle(grid, "grid")  # what all branches below start from
    reports = resolve.choose_report(filings, grid.where("status = 'ok'").select(*KEYS).distinct())
    reports = settle(reports.withColumn("path", F.when(F.col("kind") == "A001", "A").otherwise("B")), "reports")
    typed = F.when(F.col("kind") == "F002", "audit_consol").when(F.col("kind") == "F001", "audit_separate")
    a_rows = rows.join(large(reports.where("path = 'A'").select(*KEYS)), KEYS, "left_semi")
    by_rows = accounts.infer_division(a_rows).select(*KEYS, "fs_div")
    own_nodes = nodes.join(large(reports.select(*KEYS, typed.alias("report_type"))), KEYS)
    of_doc = documents.division(own_nodes).join(large(reports.select(*KEYS, typed.alias("kind_of"))), KEYS)
    said = F.when(F.col("kind_of") == "audit_consol", "CFS").when(F.col("kind_of") == "audit_separate", "OFS").otherwise(F.col("fs_div"))
    of_doc = of_doc.select(*KEYS, said.alias("doc_div"), "scope")
    divisions = reports.select(*KEYS, "path").join(large(by_rows), KEYS, "left").join(large(of_doc), KEYS, "left").select(*KEYS, "path", F.coalesce("fs_div", "doc_div").alias("fs_div"), "scope", (F.col("fs_div").isNull() & F.col("doc_div").isNotNull()).alias("from_document"))
    divisions = settle(divisions, "divisions")
    from_document = own_nodes.join(large(divisions.where("from_document").select(*KEYS)), KEYS, "left_semi")
    found = accounts.extract(a_rows, catalogue).select(*KEYS, "item", "value").unionByName(
        documents.extract(documents.with_units(documents.statement_tables(from_document)), catalogue).select(*KEYS, "item", "value")
    )
    wide = results.wide(settle(found, "items"), KEYS)
    scoped = divisions.select(*KEYS, "fs_div", "scope")

    def of_path(p: str) -> DataFrame:
        mine = divisions.where(F.col("path") == p).select(*KEYS)
        own, all_members = (None if d is None else d.join(large(mine), KEYS, "left_semi").select(*nodes.columns) for d in (own_nodes, members))
        return depreciation_of(own, scoped, p == "A", selection, all_members)

    depr = settle(of_path("A").unionByName(of_path("B")), "depreciation")
    checked = results.validated(results.positive_costs(results.overlay(wide, depr, KEYS)).withColumn("ebitda", results.ebitda()))
    found = (reports.select(*KEYS, "path", "rcept_no", "report_nm"), divisions.drop("path", "scope"), checked)
    out = functools.reduce(lambda whole, d: whole.join(large(d), KEYS, "left"), found, grid)
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("path").isNull(), "no_report").when(F.col("is_valid").isNull(), "error").otherwise("ok")
    fell_back = (F.col("path") == "A") & F.col("from_document")
    return out.withColumn("status", status).withColumn("remarks", F.coalesce("remarks", F.when(fell_back, FALLBACK))).drop("from_document")
