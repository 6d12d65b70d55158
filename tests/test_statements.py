"""The statement engine on the fixtures of FIXTURES.md."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from finstmt.functions import amounts, catalog, text, units
from finstmt.operators import accounts, compare, depreciation, documents, report, resolve, results
from finstmt.sources import landed, shred

KEYS = ["corp", "year"]
ACCOUNT = "corp string, year int, pos int, account_id string, account_nm string, sj_div string, fs_div string, thstrm_amount string, currency string"
PATH_A = [
    ("ifrs-full_Assets", "자산총계", "1,000,000,000,000"), ("ifrs-full_Liabilities", "부채총계", "400,000,000,000"), ("ifrs-full_Equity", "자본총계", "600,000,000,000"),
    ("ifrs-full_RetainedEarnings", "이익잉여금", "200,000,000,000"), ("ifrs-full_Revenue", "매출액", "800,000,000,000"), ("ifrs-full_CostOfSales", "매출원가", "500,000,000,000"),
    ("ifrs-full_GrossProfit", "매출총이익", "300,000,000,000"), ("dart_OperatingIncomeLoss", "영업이익", "100,000,000,000"), ("ifrs-full_ProfitLoss", "당기순이익", "70,000,000,000"),
]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def account_frame(spark, items, corp="c"):
    return spark.createDataFrame([(corp, 2022, i, a, n, "BS", "CFS", v, "KRW") for i, (a, n, v) in enumerate(items)], ACCOUNT)


def test_account_fixture(spark):
    found = accounts.extract(account_frame(spark, PATH_A), catalog.items(spark))
    wide = results.validated(results.wide(found, KEYS).withColumn("ebitda", results.ebitda()))
    r = rows(wide)[0]
    assert (r["assets"], r["net_income"], r["ebitda"]) == (1e12, 7e10, 1e11) and r["depr"] is None
    assert r["is_valid"] and r["flags"] == [] and [c["passed"] for c in r["checks"]] == [True] * 3


def test_account_rules(spark):
    items = [("", "자 산 총 계", "-"), ("", "총자산", "5"), ("", "계속영업영업이익", "9"), ("", "영업손실", "7"), ("", "결손금", "3"), ("ifrs-full_Revenue", "x", "N/A"), ("", "매출액", "(4)"), ("", "매출수익", " 1,2 ")]
    r = {x["item"]: (x["value"], x["method"], x["keyword"]) for x in rows(accounts.extract(account_frame(spark, items), catalog.items(spark)))}
    assert r == {"assets": (5.0, "account_nm", "총자산"), "op_income": (-7.0, "account_nm", "영업손실"), "retained": (-3.0, "account_nm", "결손금"), "revenue": (12.0, "account_nm", "매출수익")}


PATH_B = """<DOCUMENT><TITLE>연 결 재 무 상 태 표</TITLE><P>(단위: 원)</P><TABLE><TR><TD>과 목</TD><TD>당기</TD><TD>전기</TD></TR>{bs}</TABLE>
<TITLE>연 결 포 괄 손 익 계 산 서</TITLE><P>(단위: 원)<TABLE><TR><TD>과 목</TD><TD>당기</TD><TD>전기</TD></TR>{is_}</TABLE>
<TITLE>연 결 현 금 흐 름 표</TITLE><P>(단위: 원)</P><TABLE><TR><TD>과 목</TD><TD>당기</TD><TD>전기</TD></TR>{cf}<TR><TD></TD></TR></TABLE></DOCUMENT>"""


def path_b():
    line = lambda n, a, b: f"<TR><TD>{n}</TD><TU>{a}</TU><TE>{b},000,000,000</TE></TR>"
    make = lambda xs: "".join(line(n, f"{a},000,000,000", b) for n, a, b in xs)
    bs = [("자산총계", 1000, 900), ("부채총계", 400, 380), ("자본총계", 600, 520), ("이익잉여금", 200, 150)]
    is_ = [("매출액", 800, 700), ("매출원가", 500, 460), ("매출총이익", 300, 240), ("영업이익", 100, 80), ("당기순이익", 70, 55)]
    return PATH_B.format(bs=make(bs), is_=make(is_), cf=make([("감가상각비", 50, 45), ("무형자산상각비", 5, 4)]))


def nodes_of(spark, markup):
    n = shred.nodes(spark.createDataFrame([("d", bytearray(markup.encode()))], "doc_id string, content binary"))
    return n.select(F.lit("c").alias("corp"), F.lit(2022).alias("year"), *n.columns)


def test_document_fixture(spark):
    n = nodes_of(spark, path_b())
    d = documents.division(n)
    assert [(r["fs_div"], r["scope"]) for r in rows(d)] == [("CFS", True)]
    items = results.wide(documents.extract(documents.with_units(documents.sections(n)), catalog.items(spark)), KEYS)
    cf = depreciation.cash_flow_buckets(documents.with_units(depreciation.cash_flow_tables(n, d, strict=False)))
    r = rows(results.overlay(items, cf, KEYS).withColumn("ebitda", results.ebitda()))[0]
    assert (r["assets"], r["cogs"], r["depr"], r["amort"], r["rou"], r["ebitda"]) == (1e12, 5e11, 5e10, 5e9, None, 1.55e11)


def test_shredder_takes_any_marks():
    assert shred.shred("") == [] and shred.shred("<table><tr><td>a<td>b</table></x><title>t")[-1]["title_text"] == "t"
    nested = shred.shred("<P>(단위: 천원)<TABLE><TR><TD>x <b>y</b></TD></TR><TR><TD><TABLE><TR><TD>z</TD></TR></TABLE></TD></TR></TABLE>")
    assert nested[0]["rows"][0] == ["xy"] and nested[0]["prev_texts"] == ["(단위: 천원)"] and nested[1]["rows"] == [["z"]]


def test_archives_give_the_largest_member_first(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "R1.zip", "w") as z:
        z.writestr("a.xml", "<title>a</title>")
        z.writestr("b.xml", path_b())
    (tmp_path / "R2.zip").write_bytes(b"broken")
    got = rows(shred.archives(spark, str(tmp_path)).select("rcept_no", "member", "rank"))
    assert sorted((r["rank"], r["member"], r["rcept_no"]) for r in got) == [(1, "b.xml", "R1"), (2, "a.xml", "R1")]


EBITDA = [((71, 13, 4, 2), 90), ((71, None, 4, None), 75), ((None, 13, 4, 2), None), ((-8, 3, None, 1), -4), ((None, None, None, None), None)]


@pytest.mark.parametrize(("values", "want"), EBITDA)
def test_ebitda(spark, values, want):
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in values)], "op_income double, depr double, rou double, amort double")
    assert df.select(results.ebitda().alias("e")).first().e == want


@pytest.mark.parametrize(("label", "want"), [("감가상각비", True), ("투자부동산감가상각비", True), ("유형자산감가상각비", True), ("사용권자산감가상각비", False), ("무형자산상각비", False), ("대손상각비", False), ("감가상각누계액", False)])
def test_general_depreciation_labels(spark, label, want):
    assert one(spark, label, depreciation.is_general) is want


def test_labels(spark):
    for raw, want in {"I. 매출액<주석20>": "매출액", "매출원가(주석15,16,21)": "매출원가", "자      산      총      계": "자산총계", "III. 영 업 이 익": "영업이익", "V. 영업이익(손실)": "영업이익(손실)", "(2)영업이익(손실)": "영업이익(손실)"}.items():
        assert one(spark, raw, text.label) == want
    for raw, want in {"1.가.감가상각비": "감가상각비", "(1) 무형 자산상각비": "무형자산상각비", "①감가상각비": "감가상각비", "감가상각비": "감가상각비", "12": "12", "": ""}.items():
        assert one(spark, raw, text.row_label) == want
    assert one(spark, "3.연결재무제표 주석", text.title_core) == "연결재무제표주석" and one(spark, "사업보고서 (2022.12)", text.report_year) == 2022
    assert one(spark, "x\n```json\n{\"a\": 1}\n```", text.json_block) == '{"a": 1}' and one(spark, 'a/b: "c" ', text.filename_part) == "a_b_c"


@pytest.mark.parametrize(("raw", "account", "cell", "note"), [("1,234", 1234, 1234, 1234), ("(1,234)", None, -1234, -1234), ("-", None, None, None), ("–", None, None, None), ("N/A", None, None, None), (" 5 ", 5, 5, 5), ("1 2", None, None, 12), ("1d", None, None, None), (None, None, None, None)])
def test_amounts(spark, raw, account, cell, note):
    assert [one(spark, raw, f) for f in (amounts.account_amount, amounts.cell_amount, amounts.note_amount)] == [account, cell, note]


@pytest.mark.parametrize(("raw", "want"), [("(단위: 백만원)", 1_000_000), ("금액 단위 ： [천 원]", 1000), ("단위는 백만원이며", 1_000_000), ("(단위:KRW)", 1), ("단위: 달러", None), ("원", None), (None, None)])
def test_units(spark, raw, want):
    assert one(spark, raw, units.in_text) == want


SIGNS = [("이익잉여금", "(7,310,002,145)", -7310002145), ("이익잉여금(결손금)", "(7,310,002,145)", -7310002145), ("결손금", "7,310,002,145", -7310002145), ("미처리결손금", "908,117,336", -908117336), ("이익잉여금", "4,120,600", 4120600), ("이익잉여금(결손금)", "4,120,600", 4120600), ("결손금", "(7,310,002,145)", -7310002145)]


@pytest.mark.parametrize(("label", "amount", "want"), SIGNS)
def test_sign_of_retained_earnings(spark, label, amount, want):
    n = nodes_of(spark, f"<TITLE>재무상태표</TITLE><TABLE><TR><TD>과목</TD><TD>당기</TD></TR><TR><TD>{label}</TD><TD>{amount}</TD></TR></TABLE>")
    found = rows(documents.extract(documents.with_units(documents.sections(n)), catalog.items(spark)))
    assert [(r["item"], r["value"]) for r in found] == [("retained", want)]


@pytest.mark.parametrize("label", ["사용권자산상각비", "사용권자산상각비용", "사용권자산상각", "사용권자산감가상각비", "사용권자산감가상각비용", "사용권자산감가상각"])
def test_every_name_of_right_of_use_depreciation(spark, label):
    n = nodes_of(spark, f"<TITLE>현금흐름표</TITLE><TABLE><TR><TD>과목</TD><TD>당기</TD></TR><TR><TD>{label}</TD><TD>1,234</TD></TR></TABLE>")
    found = rows(documents.extract(documents.with_units(documents.sections(n)), catalog.items(spark)))
    assert [(r["item"], r["value"]) for r in found] == [("rou", 1234)]


def test_unit_inside_a_note_table(spark):
    n = nodes_of(spark, "<TITLE>주석</TITLE><TITLE>32. 현금흐름</TITLE><TABLE><TR><TD>(단위: 천원)</TD></TR><TR><TD>구분</TD><TD>당기</TD></TR><TR><TD>감가상각비</TD><TD>8,701,905</TD></TR></TABLE>")
    t = documents.with_units(depreciation.notes_candidates(n, documents.division(n), strict=False))
    assert [r["unit"] for r in rows(t)] == [1000]
    chosen = spark.createDataFrame([("c", 2022, "depr", 1, 3, False)], "corp string, year int, slot string, table_no int, row_no int, combined boolean")
    assert rows(depreciation.verify_selection(t, chosen))[0]["depr"] == 8701905000


def test_sum_of_general_rows(spark):
    body = "".join(f"<TR><TD>{n}</TD><TD>{v}</TD><TD>1</TD></TR>" for n, v in [("구분", "당기"), ("감가상각비", "434,335"), ("투자부동산 감가상각비", "15,309"), ("사용권자산감가상각비", "7"), ("무형자산상각비", "8"), ("대손상각비", "9")])
    n = nodes_of(spark, f"<TITLE>주석</TITLE><P>(단위: 천원)</P><TABLE>{body}</TABLE>")
    t = documents.with_units(depreciation.notes_candidates(n, documents.division(n), strict=False))
    chosen = spark.createDataFrame([("c", 2022, "depr", 1, 2, False), ("c", 2022, "amort", 1, 5, False)], "corp string, year int, slot string, table_no int, row_no int, combined boolean")
    r = rows(depreciation.verify_selection(t, chosen))[0]
    assert (r["depr"], r["amort"]) == (449644000, 8000)


def test_division_needs_amounts_or_the_report_type(spark):
    head = "<TITLE>2. 연결재무제표</TITLE><TITLE>연결재무상태표</TITLE><TITLE>재무상태표</TITLE>"
    own = "<TABLE><TR><TD>자산총계</TD><TD>188,922,000,000</TD></TR></TABLE>"
    assert rows(documents.division(nodes_of(spark, head + own)))[0]["fs_div"] == "OFS"
    assert rows(documents.division(nodes_of(spark, "<TITLE>연결재무상태표</TITLE>" + own)))[0]["fs_div"] == "CFS"
    for kind, want in (("audit_consol", "CFS"), ("audit_separate", "OFS")):
        assert rows(documents.division(nodes_of(spark, head + own), F.lit(kind)))[0]["fs_div"] == want


def test_registry_and_reports(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<result>" + "".join(f"<list><corp_code>{c}</corp_code><corp_name> {n} </corp_name><stock_code/><modify_date>1</modify_date></list>" for c, n in [("1", "AA"), ("2", "AAB"), ("3", "BB"), ("4", "BB")]) + "</result>")
    reg = landed.registry(spark, str(tmp_path / "c.xml"))
    names = spark.createDataFrame([("AA",), ("BB",), ("A",), ("zz",)], "name string")
    over = spark.createDataFrame([("BB", "4")], "name string, corp_code string")
    got = {r["name"]: (r["corp_code"], r["status"], r["hints"]) for r in rows(resolve.resolve(names, reg))}
    assert got == {"AA": ("1", "ok", None), "BB": (None, "ambiguous_corp", ["BB", "BB"]), "A": (None, "no_corp", ["AA", "AAB"]), "zz": (None, "no_corp", None)}
    assert {r["name"]: r["corp_code"] for r in rows(resolve.resolve(names, reg, over))}["BB"] == "4"
    filings = spark.createDataFrame([("c", "A001", "r1", "사업보고서 (2021.12)", "20220301", 0), ("c", "A001", "r2", "사업보고서 (2022.12)", "20230301", 1), ("c", "A001", "r3", "사업보고서 (2022.12)", "20230401", 2), ("c", "F001", "r4", "감사보고서", "20230501", 3)], "corp string, kind string, rcept_no string, report_nm string, rcept_dt string, pos int")
    years = spark.createDataFrame([("c", 2022), ("c", 2023)], "corp string, year int")
    assert {r["year"]: r["rcept_no"] for r in rows(resolve.choose_report(filings, years))} == {2022: "r3", 2023: "r4"}


def test_landed_accounts_keep_their_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"status": "000", "corp": "c", "year": 2022, "list": [{"account_nm": "z", "thstrm_amount": "1"}, {"account_nm": "a"}]}')
    (tmp_path / "b.json").write_text('{"status": "013", "corp": "d", "year": 2022}')
    got = rows(landed.account_rows(spark, str(tmp_path)))
    assert [(r["corp"], r["pos"], r["account_nm"]) for r in sorted(got, key=lambda r: r["pos"])] == [("c", 0, "z"), ("c", 1, "a")]


def test_combined_depreciation_and_negative_costs(spark):
    items = spark.createDataFrame([("c", 2022, *([1.0] * 5), -9.0, *([1.0] * 6))], "corp string, year int, " + ", ".join(f"{n} double" for n in catalog.NAMES))
    d = spark.createDataFrame([("c", 2022, -5.0, 2.0, 3.0, True)], "corp string, year int, depr double, rou double, amort double, combined boolean")
    r = rows(results.positive_costs(results.overlay(items, d, KEYS)))[0]
    assert (r["cogs"], r["depr"], r["rou"], r["amort"], r["turned"]) == (9.0, 5.0, None, None, ["cogs", "depr"]) and r["remarks"]


def test_identity_violations(spark):
    items = spark.createDataFrame([("c", 2022, 100.0, 60.0, 30.0, None, 50.0, 20.0, 30.0, 31.0, None, None, None, None)], "corp string, year int, " + ", ".join(f"{n} double" for n in catalog.NAMES))
    r = rows(results.validated(items))[0]
    assert not r["is_valid"] and [c["passed"] for c in r["checks"]] == [False, True, False] and r["flags"][0].startswith("[CRITICAL]") and r["flags"][1].endswith("차이=1원")


def test_outcomes(spark):
    assert [rows(spark.createDataFrame([(a, b)], "a double, b double").select(compare.disagrees(F.col("a"), F.col("b")).alias("d")))[0]["d"] for a, b in [(None, None), (1.0, None), (1000.0, 1000.9), (1000.0, 1002.0), (1e9, 1e9 + 5e5)]] == [False, True, False, True, False]
    assert one(spark, 123456789012.0, amounts.hundred_millions, "double") == "1,235" and one(spark, -2.5e8, amounts.hundred_millions, "double") == "(2)" and one(spark, 1.5e8, amounts.short, "double") == "1.5억"
    assert one(spark, "CFS", lambda c: report.division_name(F.lit("A"), c, F.lit(None))) == "연결"


def test_reports_are_written(spark, tmp_path):
    found = accounts.extract(account_frame(spark, PATH_A), catalog.items(spark))
    r = results.validated(results.wide(found, KEYS).withColumn("ebitda", results.ebitda()))
    report.write_report(r, KEYS, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/summary")
    assert back.first().ebitda == "1,000" and back.first().status == "✓ 통과"
