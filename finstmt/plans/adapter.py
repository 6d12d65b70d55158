"""Filings made out of the star schema, so that the operators have work at any scale.

A company is a supplier, a year a shipping year, so there are more filings where there is more data. Each row or node below is an SQL expression over the
facts of that company and year that both engines read; amounts are formatted as filings have them, and the
variant ``k`` (0 to 4) decides which ids are missing, which amounts are blank, and which labels are losses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shred
from ..sources.settled import settle
from . import oracle_words

TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "events", "documents", "pages", "part")

FACTS = """
SELECT s_name AS corp, CAST(year(l_shipdate) AS INT) AS year,
  CAST((s_suppkey + year(l_shipdate)) % 5 AS INT) AS k,
  1000 * CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS rev,
  600 * CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))) AS BIGINT) AS cogs,
  1000 * CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)))) AS BIGINT) AS tax,
  10000 * CAST(floor(sum(CAST(l_quantity AS DECIMAL(18,2)))) AS BIGINT) AS qty
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY s_suppkey, s_name, year(l_shipdate)
"""

#: pos, account_id, account_nm, sj_div, fs_div, thstrm_amount, currency; #x# is x with thousands separators.
ACCOUNTS = [
    ("1", "CASE WHEN k = 1 THEN '' ELSE 'ifrs-full_Assets' END", "'자 산 총 계'", "'BS'", "#qty * 3#"),
    ("2", "'ifrs-full_Liabilities'", "'부채총계'", "'BS'", "#qty#"),
    ("3", "''", "'자본 총계'", "'BS'", "CASE WHEN k = 2 THEN #qty * 2 + 70000000# ELSE #qty * 2# END"),
    ("4", "''", "CASE WHEN k = 3 THEN '미처리결손금' ELSE '이익잉여금(결손금)' END", "'BS'", "CASE WHEN k = 4 THEN '(' || #tax# || ')' ELSE #tax# END"),
    ("5", "'ifrs-full_Revenue'", "'매출액'", "'IS'", "CASE WHEN k = 4 THEN '-' ELSE #rev# END"),
    ("6", "''", "'영업 수익'", "'IS'", "#rev#"),
    ("7", "'ifrs-full_CostOfSales'", "'매출원가'", "'CIS'", "CASE WHEN k = 3 THEN '-' || #cogs# ELSE #cogs# END"),
    ("8", "'ifrs-full_GrossProfit'", "'매출총이익'", "'IS'", "CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN #rev - cogs + 5# ELSE #rev - cogs# END"),
    ("9", "'dart_OperatingIncomeLoss'", "'영업이익'", "'IS'", "#rev - cogs - tax#"),
    ("10", "''", "'계속영업당기순이익'", "'IS'", "#rev#"),
    ("11", "''", "CASE WHEN k = 2 THEN '당기순손실' ELSE '당기순이익(손실)' END", "'IS'", "#rev - cogs - tax - tax#"),
    ("12", "''", "'감가상각비'", "'CF'", "#qty + 11#"),
    ("13", "''", "CASE WHEN k = 1 THEN '무형자산 상각비' ELSE '기타' END", "'CF'", "CASE WHEN k = 1 THEN ' ' || #tax# || ' ' ELSE '' END"),
]
_ACCOUNT_COLUMNS = ("pos", "account_id", "account_nm", "sj_div", "thstrm_amount")

#: kind, title_text, rows, prev_texts; a list is written [a, b] and becomes each engine's own.
NODES = [
    ("title", "'1. 회사의 개요'", None, None),
    ("table", None, "[['구분', '내용'], ['감가상각비', #qty#]]", "['1. 회사의 개요']"),
    ("title", "CASE WHEN k = 4 THEN '재 무 상 태 표' ELSE '2-1. 연 결 재 무 상 태 표' END", None, None),
    ("table", None, "[['과 목', '당기', '전기'], ['자   산 총 계', CASE WHEN k = 2 THEN '0' ELSE #qty * 3# END, #qty#], ['II. 부채총계<주석3,4>', #qty#, '-'], ['(3)자본총계', '-', #qty#], ['결손금', #tax#, '1']]", "['(단위: 천원)', '연결재무상태표']"),
    ("title", "CASE WHEN k = 4 THEN '손익계산서' ELSE '연결포괄손익계산서' END", None, None),
    ("table", None, "[['과목', '주석', '제 ' || CAST(year - 1990 AS VARCHAR(9)) || ' 기', '제 ' || CAST(year - 1991 AS VARCHAR(9)) || ' 기'], ['Ⅰ.매출액', '4', #rev#, '1'], ['매출원가(주석15,16)', '', '(' || #cogs# || ')', '2'], ['영업이익(손실)', '5', #rev - cogs - tax#, '3'], ['당기순손실', '', #tax#, '4']]", "['금액단위 : 백만원', 'x']"),
    ("title", "CASE WHEN k = 4 THEN '4-5.현금흐름표' ELSE '연결현금흐름표' END", None, None),
    ("table", None, "[['구분', CAST(year AS VARCHAR(9)) || '년', '20' || '01년'], ['영업활동 현금흐름', #rev#, '1'], ['1.감가상각비', CASE WHEN k = 0 THEN '' ELSE #qty + 1# END, '7'], ['투자부동산감가상각비', #tax#, '8'], ['(가) 사용권자산상각비', #tax + 1#, '9'], [CASE k WHEN 0 THEN '1.사용권자산상각비' WHEN 1 THEN '사용권자산 상각비용' WHEN 2 THEN '2.사용권자산감가상각비' WHEN 3 THEN '사용권자산감가상각비용(주석3)' ELSE '사용권자산감가상각' END, #tax + 3#, '9'], [CASE WHEN k = 3 THEN '감가상각비 및 무형자산상각비' ELSE '무형자산상각비' END, #tax + 2#, '9']]", "['(단위 : 원)']"),
    ("title", "CASE WHEN k = 1 THEN '주석' WHEN k = 4 THEN '5.재무제표주석' ELSE '3. 연결재무제표 주석' END", None, None),
    ("title", "'31. 판매비와 관리비'", None, None),
    ("table", None, "[['구분', '당기', '전기'], ['감가상각비', #qty#, '2']]", "['31. 판매비와 관리비']"),
    ("title", "'32. 비용의 성격별 분류'", None, None),
    ("table", None, "[['구분', '당기', '당기', '당기', '전기'], ['', '매출원가', '판매비', '합계', '합계'], ['1.가.감가상각비', '1', '2', #qty + 5#, '3'], ['투자부동산 감가상각비', '1', '2', '-', '4'], ['사용권자산상각비', '', '', #tax + 6#, '5'], ['무형자산상각비', '1', '', #tax + 7#, '6']]", "['32. 비용의 성격별 분류', '(단위: 천원)']"),
    ("title", "'33. 유형자산'", None, None),
    ("table", None, "[['구분', '취득원가', '누계액'], ['감가상각비', '1', '2']]", "['33. 유형자산']"),
    ("table", None, "[['(단위: 백만원)'], ['구분', '당기'], ['감가상각비 및 무형자산상각비', #qty#]]", "['그 밖의 주석']"),
]


def _spark_list(text: str) -> str:
    return text.replace("[", "array(").replace("]", ")")


def _formatted(text: str, how: str) -> str:
    parts = text.split("#")
    return "".join(p if i % 2 == 0 else how.format(p) for i, p in enumerate(parts))


SPARK_NUMBER, DUCK_NUMBER = "format_number({}, 0)", "format('{{:,}}', {})"


def accounts_sql(duck: bool, accounts: list[tuple] = ACCOUNTS) -> str:
    """corp, year, pos, account_id, account_nm, sj_div, fs_div, thstrm_amount, currency over CTE facts."""
    rows = []
    for r in accounts:
        values = [_formatted(x, DUCK_NUMBER if duck else SPARK_NUMBER) for x in r]
        pairs = zip(_ACCOUNT_COLUMNS, values, strict=True)
        rows.append("{" + ", ".join(f"'{n}': {v}" for n, v in pairs) + "}" if duck else "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in pairs) + ")")
    each = "unnest([" + ", ".join(rows) + "])" if duck else "explode(array(" + ", ".join(rows) + "))"
    columns = ", ".join(f"r.{c} AS {c}" for c in _ACCOUNT_COLUMNS)
    return f"""
SELECT corp, year, {columns},
  CASE WHEN k = 1 THEN 'OFS' WHEN k = 3 AND r.pos % 2 = 0 THEN ' ofs ' WHEN k = 3 AND r.pos % 2 = 1 AND r.pos < 13 THEN 'CFS' WHEN k = 0 THEN '' ELSE 'CFS' END AS fs_div,
  CASE WHEN k = 2 AND r.pos = 7 THEN 'USD' ELSE 'KRW' END AS currency
FROM (SELECT corp, year, k, {each} AS r FROM facts) AS t
"""


def nodes_sql(duck: bool, nodes: list[tuple] = NODES) -> str:
    """doc_id (corp and year), pos, kind, title_text, rows, prev_texts over CTE facts."""
    number = DUCK_NUMBER if duck else SPARK_NUMBER
    out = []
    for i, (kind, title, rows, before) in enumerate(nodes):
        as_list = (lambda x: x) if duck else _spark_list
        none = "NULL::VARCHAR[][]" if duck else "CAST(NULL AS array<array<string>>)"
        no_text = "NULL::VARCHAR[]" if duck else "CAST(NULL AS array<string>)"
        values = [("pos", str(i)), ("kind", f"'{kind}'"), ("title_text", title or "CAST(NULL AS VARCHAR(99))"), ("rows", _formatted(as_list(rows), number) if rows else none), ("prev_texts", as_list(before) if before else no_text)]
        out.append("{" + ", ".join(f"'{n}': {v}" for n, v in values) + "}" if duck else "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in values) + ")")
    each = "unnest([" + ", ".join(out) + "])" if duck else "explode(array(" + ", ".join(out) + "))"
    return f"SELECT corp, year, r.pos AS pos, r.kind AS kind, r.title_text AS title_text, r.rows AS rows, r.prev_texts AS prev_texts FROM (SELECT corp, year, k, {each} AS r FROM facts) AS t"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, sql: str, facts: DataFrame | None = None) -> DataFrame:
    """sql over the CTE facts: the given ones, or those of the tables."""
    if facts is not None:
        return spark.sql(f"WITH facts AS (SELECT * FROM {{known}}) {sql}", known=facts)
    named = {t: table(spark, sf_dir, t) for t in ("lineitem", "supplier")}
    of_tables = FACTS.replace("lineitem", "{lineitem}").replace("JOIN supplier", "JOIN {supplier}")
    return spark.sql(f"WITH facts AS ({of_tables}) {sql}", **named)


#: Filings of one task. A filing's nodes take some 10 KB, so that what a task sorts does not follow the input.
FILINGS_A_TASK = 4_000


def spread(filings: DataFrame) -> DataFrame:
    """filings by company and year, in partitions by their number: one is small, what is made of it is not, so a partition's
    size in bytes (by which Spark would join them to one for each core) tells nothing."""
    n = -(-filings.count() // FILINGS_A_TASK)
    return filings.repartition(max(filings.sparkSession.sparkContext.defaultParallelism, n), "corp", "year")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every company and year, summed once, and spread by company and year: whatever a query makes of them
    (rows, nodes, windows over a document) stays in place."""
    return spread(settle(_over(spark, sf_dir, "SELECT * FROM facts"), "facts"))


def accounts(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    return _over(spark, sf_dir, accounts_sql(duck=False), facts)


def nodes(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    return _over(spark, sf_dir, nodes_sql(duck=False), facts)


#: Which member of a filing's archive a node lies in: the document alone; a cover and the rest; all but the cash flow and
#: the cash flow; or covers only.
MEMBERS = """
SELECT corp, year, CASE layout WHEN 1 THEN CAST(pos >= 2 AS INT) WHEN 2 THEN CAST(pos IN (6, 7) AS INT) WHEN 3 THEN pos ELSE 0 END AS member, pos, kind, title_text, rows, prev_texts
FROM (SELECT node.*, CASE WHEN (qty + year) % 7 < 3 THEN 0 ELSE (qty + year) % 7 - 3 END AS layout FROM node JOIN (SELECT corp AS c, year AS y, qty DIV 10000 AS qty FROM facts) AS f ON corp = c AND year = y) AS laid
WHERE layout < 3 OR pos < 2
"""
#: The division that a filing is asked for: mostly that of its document.
DIVISIONS = "SELECT corp, year, CASE WHEN k = 4 OR (k = 2 AND year % 2 = 0) THEN 'OFS' ELSE 'CFS' END AS fs_div FROM facts"


def members_sql(duck: bool) -> str:
    return MEMBERS.replace(" DIV ", " // ") if duck else MEMBERS


def members(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Nodes of archives: member (0: the largest document) and the columns of nodes()."""
    return _over(spark, sf_dir, f", node AS ({nodes_sql(duck=False)}) {members_sql(duck=False)}", facts)


def divisions(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    return _over(spark, sf_dir, DIVISIONS, facts)


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def markup(of: DataFrame) -> DataFrame:
    """rcept_no, member, content: the nodes of each company and year as one marked-up document, and a short cover."""
    tagged = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    joined = lambda cs: F.array_join(cs, "")
    before = joined(F.transform(F.reverse(F.coalesce("prev_texts", F.array().cast("array<string>"))), lambda t: tagged("P", _escaped(t))))
    body = joined(F.transform("rows", lambda r: tagged("TR", joined(F.transform(r, lambda c: tagged("TD", _escaped(c)))))))
    node = F.when(F.col("kind") == "title", tagged("TITLE", _escaped(F.col("title_text")))).otherwise(tagged("DIV", tagged("DIV", F.concat(before, tagged("TABLE", body)))))
    whole = of.groupBy("corp", "year").agg(joined(F.sort_array(F.collect_list(F.struct("pos", node.alias("m"))))["m"]).alias("m"))
    text = F.struct(F.lit("document.xml").alias("member"), tagged("BODY", F.col("m")).alias("content"))
    cover = F.struct(F.lit("a-cover.xml").alias("member"), F.lit("<BODY><TITLE>1. 표지</TITLE></BODY>").alias("content"))
    return whole.select(F.concat("corp", F.lit("~"), "year").alias("rcept_no"), F.explode(F.array(text, cover)).alias("d")).select("rcept_no", "d.member", F.encode("d.content", "UTF-8").alias("content"))


#: Archives of one folder.
ARCHIVES_A_FOLDER = 10_000


def archived(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """nodes() once more, by way of ZIP archives in ``root``: written, read member by member, and shredded."""
    known = facts(spark, sf_dir)
    shred.write_archives(markup(nodes(spark, sf_dir, known)), root, -(-known.count() // ARCHIVES_A_FOLDER))
    largest = shred.archives(spark, root).where("rank = 1").select(F.col("rcept_no").alias("doc_id"), "content")
    key = F.split("doc_id", "~")
    return shred.nodes(largest).select(key[0].alias("corp"), key[1].cast("int").alias("year"), "*").drop("doc_id")


#: A page of two tables, the second one's cells spanning rows and columns; k decides what it says of its encoding.
PAGE = """
SELECT concat(corp, '~', year) AS doc_id, k, concat('<html><head>', CASE k WHEN 0 THEN '<meta charset="utf-8">' WHEN 1 THEN '<meta http-equiv="Content-Type" content="text/html; charset=euc-kr">' ELSE '' END, '</head><body>',
  '<p>회사 개요</p><table><tr><td>상호<td>', replace(corp, chr(35), ' '), '</table><div><p>(단위: 천원)</p><table><tr><th rowspan=2>과목<th colspan="2">금액</th></tr><tr><th>당기<th>전기</tr>',
  '<tr><td>자산 총계<td>', #qty * 3#, '<td rowspan="3">-</tr><tr><td>Ⅱ.부채총계<td>', #qty#, '</tr><tr><td>결손금<td>(', #tax#, ')</tr><tr><td colspan=3>주석</table></div></body></html>') AS page FROM facts
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: pages in UTF-8 (k 0, 2, 4) or EUC-KR (1, 3), which some of them declare."""

    @F.pandas_udf("binary")
    def encoded(page: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([p.encode("euc-kr" if n in (1, 3) else "utf-8") for p, n in zip(page, k, strict=True)])

    return _over(spark, sf_dir, _formatted(PAGE, SPARK_NUMBER)).select("doc_id", encoded("page", "k").alias("content"))


#: A small filing for each word w that any rule looks for: as title, label, caption, header and account, so that every
#: word of every rule is met. The words are input here, taken from those of the SQL.
WORD_ACCOUNTS = [
    ("1", "w", "'기타'", "'BS'", "'10'"), ("2", "''", "w", "'BS'", "'20'"), ("3", "''", "w || '영업이익'", "'IS'", "'30'"), ("4", "''", "w || '당기순이익'", "'IS'", "'40'"),
]
WORD_NODES = [
    ("title", "w", None, None),
    ("table", None, "[['구분', '당기', '전기'], [w, '5', '6']]", "['단위: ' || w]"),
    ("title", "'연결' || w", None, None),
    ("table", None, "[['구분', '당기', '전기'], [w, '5', '6'], ['자산총계', '1', '2']]", "['x']"),
    ("title", "'현금흐름표'", None, None),
    ("table", None, "[['구분', '당기'], ['감가상각비', '7']]", "['x']"),
    ("title", "w", None, None),
    ("table", None, "[['구분', '당기'], [w, '8']]", "['1. 가']"),
    ("title", "'주석'", None, None),
    ("table", None, "[['구분', '당기'], ['감가상각비', '7']]", "['1. ' || w]"),
    ("table", None, "[[w, '당기'], ['감가상각비', '7']]", "['2. 가나다']"),
    ("table", None, "[['구분', '당기'], [w, '9'], ['감가상각비용', '-']]", "['3. 가나다']"),
    ("title", "w", None, None),
    ("table", None, "[['영업활동현금흐름', '당기'], ['감가상각비', '3']]", "['4. 가나다']"),
]


def words_sql(duck: bool) -> str:
    """corp, year, k, w: for each part one of the words, in turn."""
    w = oracle_words
    ids = [i[3] for i in w.ITEMS if i[3]]
    named = [x for i in w.ITEMS for part in i[4:] for x in part]
    told = [*w.BS_WORDS, *w.IS_WORDS, *w.TOTALS, *w.STATEMENT_TITLES, *w.SCOPE_TITLES, *w.STATEMENT_ROOTS, *w.NOTES_ROOTS, *w.EXCLUDED_HEADERS, *w.PARTIAL_TITLES, *w.EXACT_DEPR, *w.EXACT_ROU, *w.EXACT_AMORT, *w.CF_MARKERS, *(a for a, _ in w.SECTIONS), *w.UNITS]
    every = sorted({*ids, *named, *told})
    listed = ", ".join(f"'{x}'" for x in every)
    chosen = f"([{listed}])[p_partkey % {len(every)} + 1]" if duck else f"array({listed})[p_partkey % {len(every)}]"
    return f"SELECT concat('W', p_partkey) AS corp, CAST(2000 AS INT) AS year, CAST(0 AS INT) AS k, {chosen} AS w FROM {'part' if duck else '{part}'}"


def word_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(words_sql(duck=False), part=table(spark, sf_dir, "part"))


def word_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, nodes_sql(False, WORD_NODES), spread(word_facts(spark, sf_dir)))


def word_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, accounts_sql(False, WORD_ACCOUNTS), spread(word_facts(spark, sf_dir)))
