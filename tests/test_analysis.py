"""Both fixtures, and what has no company, no report or no rows, in one run."""

from pyspark.sql import functions as F

from finstmt.functions import catalog
from finstmt.operators import accounts, analysis, details, documents, trace

from .test_statements import ACCOUNT, KEYS, PATH_A, nodes_of, path_b, rows


def test_all_at_once(spark):
    names = spark.createDataFrame([("Acme",), ("Beta",), ("Dup",), ("none",), ("Idle",), ("Paper",)], "name string")
    years = spark.createDataFrame([(2022,)], "year int")
    reg = spark.createDataFrame([("a", "Acme", 1), ("b", "Beta", 2), ("x", "Dup", 3), ("y", "Dup", 4), ("i", "Idle", 5), ("p", "Paper", 6)], "corp_code string, corp_name string, pos int")
    filings = spark.createDataFrame([("a", "A001", "r1", "사업보고서 (2022.12)", "20230301", 0), ("b", "F002", "r2", "연결감사보고서 (2022.12)", "20230301", 0), ("p", "A001", "r3", "사업보고서 (2022.12)", "20230301", 0)], "corp string, kind string, rcept_no string, report_nm string, rcept_dt string, pos int")
    acct = spark.createDataFrame([("a", 2022, i, c, n, "BS", "CFS", v, "KRW") for i, (c, n, v) in enumerate(PATH_A)], ACCOUNT)
    doc = nodes_of(spark, path_b()).drop("corp")
    nodes = doc.withColumn("corp", F.lit("b")).unionByName(doc.withColumn("corp", F.lit("p")))
    out = {r["name"]: r for r in rows(analysis.analyze(names, years, reg, filings, acct, nodes, catalog.items(spark)))}
    assert {n: r["status"] for n, r in out.items()} == {"Acme": "ok", "Beta": "ok", "Dup": "ambiguous_corp", "none": "no_corp", "Idle": "no_report", "Paper": "ok"}
    assert (out["Acme"]["ebitda"], out["Acme"]["path"], out["Acme"]["fs_div"], out["Acme"]["remarks"]) == (1e11, "A", "CFS", None)
    assert (out["Beta"]["ebitda"], out["Beta"]["path"], out["Beta"]["fs_div"], out["Beta"]["depr_source"]) == (1.55e11, "B", "CFS", "cf")
    assert (out["Paper"]["ebitda"], out["Paper"]["path"], out["Paper"]["remarks"]) == (1.55e11, "A", analysis.FALLBACK)


def test_details(spark):
    more = "thstrm_nm string, ord string"
    acct = spark.createDataFrame([("a", 2022, 0, "", " 결손금 ", "BS", "CFS", " 5 ", "KRW", None, "1"), ("a", 2022, 1, "ifrs-full_Assets", "자산", "BS", " ", "7", "USD", " 제 3 기 ", None)], f"{ACCOUNT}, {more}")
    d = {r["item"]: r["detail"] for r in rows(details.of_accounts(accounts.extract(acct, catalog.items(spark), origin=True)))}
    assert d["retained"]["flags"] == ["matched_by_account_nm", "matched_keyword:결손금", "negated_by_label"] and (d["retained"]["value"], d["retained"]["raw_value"]) == (-5, " 5 ")
    assert d["assets"]["confidence"] == "low_confidence" and d["assets"]["flags"] == ["matched_by_account_id", "non_krw_currency:USD"]
    s = d["assets"]["source"]
    assert (s["column_label"], s["fs_div"], s["account_nm"], s["ord"], d["retained"]["source"]["column_label"], d["retained"]["source"]["ord"]) == ("제 3 기", None, "자산", None, "당기", "1")


def test_details_of_cells(spark):
    tables = documents.with_units(documents.sections(nodes_of(spark, path_b())))
    found = details.of_documents(documents.extract(tables, catalog.items(spark), origin=True))
    assert [tuple(r) for r in found.drop("detail").select(*KEYS, "item", "value").orderBy("item").collect()] == [tuple(r) for r in documents.extract(tables, catalog.items(spark)).select(*KEYS, "item", "value").orderBy("item").collect()]
    one = found.where("item = 'assets'").withColumn("detail", details.annotate(F.col("detail"), rcept_no=F.lit("r9"), source_type=F.lit("other")))
    d = F.col("detail")
    got = rows(one.select("detail", details.final(d, F.lit(None).cast("double")).alias("gone"), details.final(d, F.lit(3.0), F.lit("adjudicated"), F.lit("1 vs 3")).alias("new"), details.final(d, d["value"]).alias("same")))[0]
    s = got["detail"]["source"]
    assert s["rcept_no"] == "r9" and s["source_type"] == "document_xml" and s["table_id"] == "BS1" and got["detail"]["raw_value"] and got["same"] == got["detail"]
    assert got["gone"]["confidence"] == "missing" and got["gone"]["value_state"] == "missing" and '"table_id":"BS1"' in got["gone"]["source"]["previous_source"]
    assert got["new"]["confidence"] == "unverified_ai_value" and got["new"]["value"] == 3.0 and got["new"]["source"]["disagreement"] == "1 vs 3" and got["new"]["raw_value"] is None


def test_cells_that_are_no_numbers_and_columns_that_are_not_known(spark):
    body = lambda rs: "<TABLE>" + "".join("<TR>" + "".join(f"<TD>{c}</TD>" for c in r) + "</TR>" for r in rs) + "</TABLE>"
    text = "<TITLE>재무상태표</TITLE>" + body([["과목", "당기", "전기"], ["자산총계", "-", "5"]]) + body([["과목", "주석", "금액"], ["부채총계", "3", "(8)"], ["결손금", "1", "9"]]) + "<TITLE>손익계산서</TITLE>" + body([["과목", "당기"], ["매출원가", "(7)"]])
    found = details.of_documents(documents.extract(documents.with_units(documents.sections(nodes_of(spark, text))), catalog.items(spark), origin=True))
    d = {r["item"]: r["detail"] for r in rows(found)}
    assert (d["assets"]["value"], d["assets"]["raw_value"], d["assets"]["value_state"]) == (0.0, "-", "zero_assumed_from_non_numeric_current_cell")
    assert d["assets"]["flags"] == ["matched_by_normalized_label", "non_numeric_current_cell_zero_assumed", "unit_assumed_won"] and d["assets"]["source"]["column_label"] == "당기 / -"
    s = d["liabilities"]["source"]
    assert (s["table_id"], s["row_id"], s["column_id"], s["column_label"], d["liabilities"]["value"]) == ("BS2", "R2", "C3", "금액", -8.0) and "first_numeric_column_used" in d["liabilities"]["flags"]
    assert d["retained"]["value"] == -9.0 and "negated_by_label" in d["retained"]["flags"] and d["cogs"]["value"] == 7.0 and "force_positive" in d["cogs"]["flags"]
    every = details.every_item(found, spark.createDataFrame([("c", 2022), ("none", 2022)], "corp string, year int"), KEYS, "document_xml")
    assert every.count() == 24 and {r["corp"]: details_ok for r in rows(details.values(every, KEYS).withColumn("ok", details.successful(F.col("items")))) for details_ok in [r["ok"]]} == {"c": True, "none": False}
    missing = rows(every.where("corp = 'none' and item = 'depr'"))[0]["detail"]
    assert (missing["value_state"], missing["flags"], missing["source"]["statement"]) == ("missing", ["not_found"], "CF")


def test_details_of_depreciation(spark):
    got = details.of_depreciation(spark.createDataFrame([("c", 2022, 5.0, None, None, True, "cf", "CFS")], "corp string, year int, depr double, rou double, amort double, combined boolean, source string, fs_div string"), KEYS)
    d = {r["item"]: r["detail"] for r in rows(got)}
    assert d["depr"]["flags"] == ["depreciation_position_in_trace", "combined_depreciation_and_amortization"] and d["depr"]["source"]["depreciation_source"] == "cf" and d["rou"]["confidence"] == "missing"


def test_other_members_of_the_archive_where_the_first_gives_nothing(spark):
    first = spark.createDataFrame([("b", 2022, 0, "title", "1. 개요", None, None), ("c", 2022, 0, "title", "1. 개요", None, None)], nodes_of(spark, path_b()).select(*KEYS, "pos", "kind", "title_text", "rows", "prev_texts").schema)
    second = nodes_of(spark, path_b()).withColumn("corp", F.lit("b")).select(*first.columns)
    merged = documents.merged_members(first.withColumn("member", F.lit(0)).unionByName(second.withColumn("member", F.lit(1))))
    assert [r["pos"] for r in merged.orderBy("pos").collect()] == list(range(second.count() + 1)) and merged.where("corp = 'c'").isEmpty()
    divisions = spark.createDataFrame([("b", 2022, "CFS", True), ("c", 2022, "CFS", True)], "corp string, year int, fs_div string, scope boolean")
    alone = rows(analysis.depreciation_of(second, divisions, False))
    assert rows(analysis.depreciation_of(first, divisions, False)) == []
    assert rows(analysis.depreciation_of(first, divisions, False, members=merged)) == alone and alone[0]["depr"] is not None


NODE = "corp string, year int, member int, pos int, kind string, title_text string, rows array<array<string>>, prev_texts array<string>"


def archives(spark):
    """a: all in one document; b: a cover, then consolidated statements and notes; c: a cover alone; d: notes first, cash flow apart."""
    cover, cash = ("title", "1. 개요", None), ("title", "연결현금흐름표", None)
    flow = ("table", None, [["구분", "당기"], ["감가상각비", "5"], ["무형자산상각비", "6"]])
    notes = [("title", "3. 연결재무제표 주석", None), ("table", None, [["구분", "당기"], ["감가상각비", "77"], ["무형자산상각비", "8"]])]
    balance = [("title", "연결재무상태표", None), ("table", None, [["자산총계", "9"]])]
    docs = {"a": [[*balance, cash, flow, *notes]], "b": [[cover], [*balance, *notes]], "c": [[cover], [cover]], "d": [notes, [*balance, cash, flow]], "e": [[cover], [*balance, cash, flow]]}
    found = [(c, 2022, m, i, k, t, r, []) for c, members in docs.items() for m, nodes in enumerate(members) for i, (k, t, r) in enumerate(nodes)]
    return spark.createDataFrame(found, NODE)


def evaluated(spark, fs_div):
    nodes = archives(spark)
    first = nodes.where("member = 0").drop("member")
    divisions = documents.division(first).select(*KEYS, F.lit(fs_div).alias("fs_div"), "scope")
    return analysis.stages(first, divisions, True, documents.merged_members(nodes))


def choice(spark):
    slots = [("depr", 2), ("amort", 3)]
    return spark.createDataFrame([(c, 2022, s, 1, r, False) for c in "abcde" for s, r in slots], "corp string, year int, slot string, table_no int, row_no int, combined boolean")


def test_stages_of_depreciation(spark):
    found = evaluated(spark, "CFS")
    assert {r["corp"]: r["scope"] for r in rows(found.again)} == {"b": True, "c": None, "e": True}
    got = {r["corp"]: (r["depr"], r["amort"], r["source"]) for r in rows(analysis.result_of(found, choice(spark)))}
    assert got == {"a": (5.0, 6.0, "cf"), "b": (77.0, 8.0, "notes"), "d": (77.0, 8.0, "notes"), "e": (5.0, 6.0, "cf")}
    assert {r["corp"] for r in rows(analysis.result_of(found))} == {"a", "e"}


def test_scope_of_merged_members_is_their_own(spark):
    """Asked for separate statements, consolidated notes of a second member are no candidates."""
    found = evaluated(spark, "OFS")
    assert "b" not in {r["corp"] for r in rows(found.candidates_again)}
    assert {r["corp"]: r["source"] for r in rows(analysis.result_of(found, choice(spark)))}.get("b") is None


def test_trace_tells_the_steps_in_order(spark):
    found = evaluated(spark, "CFS")
    seen, counts = trace.counted(trace.events(found, True, choice(spark)))
    told = {}
    for r in sorted(rows(trace.lines(seen)), key=lambda r: (r["corp"], r["pos"])):
        told.setdefault(r["corp"], []).append(r["line"])
    assert [x.split("]")[0][1:] for x in told["a"]] == ["START", "LOAD", "CF", "FINAL"]
    assert [x.split("]")[0][1:] for x in told["b"]] == ["START", "LOAD", "CF", "NOTES", "RETRY", "CF", "RETRY", "NOTES", "NOTES", "FINAL"]
    assert told["b"][4].endswith("document_scope=True") and told["b"][-3] == "[NOTES] T1 [SEPARATE_PAIR] title=- / labels=구분, 감가상각비, 무형자산상각비"
    assert told["c"][-1] == "[FINAL] source=error, combined=False, 감가상각비=None, 사용권자산상각비=None, 무형자산상각비=None"
    assert told["d"][-1] == "[FINAL] source=notes, combined=False, 감가상각비=77.0, 사용권자산상각비=None, 무형자산상각비=8.0"
    assert counts.get["events"] == sum(map(len, told.values())) and counts.get["FINAL"] == counts.get["START"] == 5


def test_trace_is_written_by_filing(spark, tmp_path):
    from finstmt.operators import report

    counts = report.write_trace(trace.events(evaluated(spark, "CFS"), True, choice(spark)), str(tmp_path))
    text = [f.read_text() for f in (tmp_path / "corp=a" / "year=2022").glob("*.txt")]
    assert len(text) == 1 and text[0].splitlines()[0] == "[START] fs_div=CFS, strict_scope=True" and len(text[0].splitlines()) == 4
    assert counts["START"] == 5
