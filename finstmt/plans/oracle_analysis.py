"""Plain SQL of the staged evaluation of depreciation, its trace, and item details."""

from __future__ import annotations

from . import adapter
from .oracle import ACCOUNTS, CATALOGUE, CHECKED, COMPARED, EBITDA, EXTRACT, MERGED, WIDE, cell_amount, gone, label, trim
from .oracle_docs import _NUMBERS, _SAYS, BUCKETS, DIVISION, NODES, NOTES, ROWS, SECTIONS, UNITS, current
from .oracle_docs import SQL as DOCS

_VERIFY = DOCS["position_verify"].split(DIVISION + ", ", 1)[1]
_TITLE = "coalesce(list_filter(list_transform(prev_texts, lambda x: regexp_extract(x, '^([0-9]+[.]?[ ]*.{2,40})', 1)), lambda x: x <> '')[1], '-')"


def _over(nodes: str, body: str) -> str:
    """body, which follows the CTEs node and division, over these nodes and the division that was asked for."""
    return f"(WITH RECURSIVE node AS MATERIALIZED ({nodes}), {DIVISION.replace('division AS (', 'told AS (')}, division AS (SELECT corp, year, asked.fs_div, scope FROM told JOIN asked USING (corp, year)), {body})"


def _pass(n: int, nodes: str) -> str:
    kept = f"SELECT corp, year, table_no, {_SAYS['exact']} AS exact, {_SAYS['amort']} AS amort, {_SAYS['combined']} AS combined, {_TITLE} AS title, array_to_string(list_transform(rows[1:5], lambda r: {trim('r[1]')}), ', ') AS labels FROM kept"
    return f"""scope{n} AS MATERIALIZED {_over(nodes, 'fin AS (SELECT 1) SELECT * FROM division')},
b{n} AS MATERIALIZED {_over(nodes, f'{BUCKETS} SELECT *, depr IS NOT NULL AND (amort IS NOT NULL OR combined) AS done, coalesce(depr, rou, amort) IS NOT NULL AS has FROM bucket')},
k{n} AS MATERIALIZED {_over(nodes, f'{NOTES} {kept}')},
v{n} AS MATERIALIZED (SELECT v.*, n FROM {_over(nodes, _VERIFY)} v JOIN (SELECT corp, year, count(*) AS n FROM k{n} GROUP BY ALL) USING (corp, year))"""


STAGES = f"""WITH RECURSIVE {NODES}, asked AS ({adapter.DIVISIONS}), mem AS MATERIALIZED ({adapter.members_sql(duck=True)}),
{_pass(1, 'SELECT * EXCLUDE member FROM mem WHERE member = 0')},
retry AS MATERIALIZED (SELECT corp, year FROM mem GROUP BY ALL HAVING max(member) > 0 EXCEPT (SELECT corp, year FROM b1 WHERE has UNION SELECT corp, year FROM k1)),
{_pass(2, 'SELECT corp, year, CAST(row_number() OVER (PARTITION BY corp, year ORDER BY member, pos) - 1 AS INT) AS pos, kind, title_text, rows, prev_texts FROM mem JOIN retry USING (corp, year)')},
cf AS (SELECT corp, year, depr, rou, amort, combined, done FROM b1 WHERE has UNION ALL SELECT corp, year, depr, rou, amort, combined, true FROM b2 WHERE done),
nt AS (SELECT corp, year, depr AS nd, rou AS nr, amort AS na, combined AS nc, n FROM v1 UNION ALL SELECT corp, year, depr, rou, amort, combined, n FROM v2 WHERE (corp, year) NOT IN (SELECT (corp, year) FROM b2 WHERE done)),
ended AS MATERIALIZED (SELECT a.corp, a.year, CASE WHEN done THEN depr ELSE coalesce(depr, nd) END AS depr, CASE WHEN done THEN rou ELSE coalesce(rou, nr) END AS rou, CASE WHEN done THEN amort ELSE coalesce(amort, na) END AS amort,
  coalesce(combined, false) OR (NOT coalesce(done, false) AND coalesce(nc, false)) AS combined,
  CASE WHEN coalesce(done, false) THEN 'cf' WHEN coalesce(depr, rou, amort) IS NOT NULL AND coalesce(nd, nr, na) IS NOT NULL THEN 'cf+notes' WHEN coalesce(depr, rou, amort) IS NOT NULL THEN 'cf' WHEN coalesce(nd, nr, na) IS NOT NULL THEN 'notes' ELSE 'error' END AS source,
  CASE WHEN coalesce(done, false) THEN 0 ELSE coalesce(n, 0) END AS n_candidates, (a.corp, a.year) IN (SELECT (corp, year) FROM retry) AS again
  FROM asked a LEFT JOIN cf USING (corp, year) LEFT JOIN nt USING (corp, year))"""

SQL = {"depreciation_analysis": f"{STAGES} SELECT corp, year, depr, rou, amort, combined, source, n_candidates, again FROM ended"}


def _told(c: str) -> str:
    return f"CASE {c} WHEN true THEN 'True' WHEN false THEN 'False' ELSE 'None' END"


_SHOWN = "'감가상각비=' || coalesce(CAST(depr AS VARCHAR), 'None') || ', 사용권자산상각비=' || coalesce(CAST(rou AS VARCHAR), 'None') || ', 무형자산상각비=' || coalesce(CAST(amort AS VARCHAR), 'None')"
_MARKS = "CASE WHEN exact AND amort THEN CASE WHEN combined THEN '[SEPARATE_PAIR/COMBINED] ' ELSE '[SEPARATE_PAIR] ' END WHEN exact THEN CASE WHEN combined THEN '[depr/COMBINED] ' ELSE '[depr] ' END WHEN combined THEN '[COMBINED] ' ELSE '' END"
_CF = "SELECT d.corp, d.year, {stage} AS o, 0 AS sub, '[CF] Python 추출 결과: ' || " + _SHOWN + " || ', combined=' || " + _told("coalesce(combined, false)") + " AS line FROM {docs} d LEFT JOIN {buckets} USING (corp, year)"
_COUNT = "SELECT d.corp, d.year, {stage} AS o, 0 AS sub, '[{tag}] {said} ' || (SELECT count(*) FROM {kept} k WHERE k.corp = d.corp AND k.year = d.year) || '개' AS line FROM {docs} d WHERE (d.corp, d.year) NOT IN (SELECT (corp, year) FROM {buckets} WHERE done)"
_EACH = "SELECT corp, year, {stage} AS o, table_no AS sub, '[NOTES] T' || table_no || ' ' || " + _MARKS + " || 'title=' || title || ' / labels=' || labels AS line FROM {kept} WHERE (corp, year) NOT IN (SELECT (corp, year) FROM {buckets} WHERE done)"
EVENTS = " UNION ALL ".join([
    "SELECT corp, year, 0 AS o, 0 AS sub, '[START] fs_div=' || fs_div || ', strict_scope=True' AS line FROM scope1",
    f"SELECT corp, year, 1 AS o, 0 AS sub, '[LOAD] document_scope=' || {_told('scope')} AS line FROM scope1",
    _CF.format(stage=2, docs="scope1", buckets="b1"),
    _COUNT.format(stage=3, docs="scope1", buckets="b1", kept="k1", tag="NOTES", said="후보 테이블"),
    _EACH.format(stage=4, buckets="b1", kept="k1"),
    f"SELECT corp, year, 5 AS o, 0 AS sub, '[RETRY] 최대 파일에서 결과 없음, 병합 재시도, document_scope=' || {_told('scope')} AS line FROM scope2",
    _CF.format(stage=6, docs="scope2", buckets="b2"),
    _COUNT.format(stage=7, docs="scope2", buckets="b2", kept="k2", tag="RETRY", said="병합 파일에서 후보 테이블"),
    _EACH.format(stage=8, buckets="b2", kept="k2"),
    "SELECT corp, year, 9 AS o, 0 AS sub, '[NOTES] AI 선택 결과: ' || CASE WHEN year % 3 = 0 THEN 'depr=T1/R99' ELSE 'depr=T1/R3' END || ', rou=T1/R5, amort=T1/R6' AS line FROM nt WHERE (corp, year) NOT IN (SELECT (corp, year) FROM b1 WHERE done)",
    f"SELECT corp, year, 10 AS o, 0 AS sub, '[FINAL] source=' || source || ', combined=' || {_told('combined')} || ', ' || {_SHOWN} AS line FROM ended",
])
SQL["trace_lines"] = f"{STAGES}, ev AS ({EVENTS}) SELECT corp, year, CAST(row_number() OVER (PARTITION BY corp, year ORDER BY o, sub) AS INT) AS pos, line FROM ev"

_NO_SOURCE = ["ord", "table_id", "row_id", "row_label", "normalized_row_label", "unit_confidence"]
#: Details of account rows: the row of the match once more, by its place.
OF_ROWS = """det AS (
  SELECT f.corp, f.year, f.item, f.amount AS value, a.thstrm_amount AS raw_value, 1 AS unit_multiplier, CASE WHEN stage = 2 OR a.currency <> 'KRW' THEN 'low_confidence' ELSE 'verified' END AS confidence, 'extracted' AS value_state,
    array_to_string(list_filter([CASE stage WHEN 1 THEN 'matched_by_account_id' ELSE 'matched_by_account_nm' END, 'matched_keyword:' || keyword, CASE WHEN stage = 2 AND list_contains(negated, keyword) AND f.amount < 0 AND NOT starts_with(trim(a.thstrm_amount), '-') THEN 'negated_by_label' END,
      CASE WHEN a.currency <> 'KRW' THEN 'non_krw_currency:' || a.currency END], lambda x: x IS NOT NULL), ',') AS flags,
    'dart_api' AS source_type, nullif(trim(a.fs_div), '') AS fs_div, nullif(trim(a.sj_div), '') AS statement, nullif(trim(a.account_id), '') AS account_id, nullif(trim(a.account_nm), '') AS account_nm, a.currency, 'thstrm_amount' AS column_id, '당기' AS column_label
  FROM found f JOIN acct a USING (corp, year, pos) JOIN (SELECT item, negated FROM cat) USING (item)
), ad AS (
  SELECT x.corp, x.year, x.item, value, raw_value, unit_multiplier, coalesce(confidence, 'missing') AS confidence, coalesce(value_state, 'missing') AS value_state, coalesce(flags, 'not_found') AS flags, 'dart_api' AS source_type, fs_div, d.statement, account_id, account_nm, currency, column_id, column_label
  FROM (SELECT corp, year, item FROM facts, cat) x LEFT JOIN det d USING (corp, year, item)
)"""
_BLANK = ", ".join(f"NULL AS {c}" for c in _NO_SOURCE)
_COLUMN = f"(SELECT string_agg(c, ' / ' ORDER BY o) FROM (SELECT c, min(i) AS o FROM (SELECT i, {trim(gone('h.c', '[ ' + chr(9) + ']+', ' '))} AS c FROM hc h WHERE h.corp = w.corp AND h.year = w.year AND h.pos = w.pos AND h.j = w.col) WHERE c <> '' AND {cell_amount('c')} IS NULL GROUP BY c))"
OF_CELLS = f"""sec0 AS (SELECT *, row_number() OVER (PARTITION BY corp, year, section ORDER BY pos) AS table_no FROM sec), tab AS (SELECT * FROM sec0), {UNITS}, {current(False)}, {ROWS},
kw AS (SELECT item, statement, negated, unnest(keywords) AS word FROM cat),
m AS (SELECT tr.*, table_no, section, item, negated, word, {cell_amount('r[cur + 1]')} AS here, cur IS NOT NULL AND cur < len(r) AS known,
  list_filter({_NUMBERS(cell_amount)}, lambda z: NOT contains({gone('coalesce(head[z.j + 1], chr(32))', '[ ' + chr(9) + ']+')}, '주석'))[1] AS fst FROM tr JOIN tab USING (corp, year, pos) JOIN kw ON statement = section AND word = {label('r[1]')}),
v AS (SELECT *, CASE WHEN known THEN coalesce(here, 0) ELSE fst.v END * unit AS v0, CASE WHEN known THEN cur ELSE fst.j END AS col FROM m),
w AS (SELECT *, item = 'cogs' AND v0 < 0 AS forced, list_contains(negated, word) AND v0 > 0 AS turned FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, item ORDER BY pos, row_no) AS o FROM v WHERE v0 IS NOT NULL) WHERE o = 1),
dd AS (SELECT corp, year, item, CASE WHEN forced OR turned THEN -v0 ELSE v0 END AS value, r[col + 1] AS raw_value, unit AS unit_multiplier, CASE WHEN known AND here IS NOT NULL AND sure <> 'assumed_won' THEN 'verified' ELSE 'low_confidence' END AS confidence,
  CASE WHEN known AND here IS NULL THEN 'zero_assumed_from_non_numeric_current_cell' ELSE 'extracted' END AS value_state,
  array_to_string(list_filter(['matched_by_normalized_label', CASE WHEN known AND here IS NULL THEN 'non_numeric_current_cell_zero_assumed' END, CASE WHEN NOT known THEN 'current_column_not_detected' END, CASE WHEN NOT known THEN 'first_numeric_column_used' END,
    CASE WHEN forced THEN 'force_positive' END, CASE WHEN turned THEN 'negated_by_label' END, CASE WHEN sure = 'assumed_won' THEN 'unit_assumed_won' END], lambda x: x IS NOT NULL), ',') AS flags,
  section || table_no AS table_id, 'R' || row_no AS row_id, r[1] AS row_label, word AS normalized_row_label, 'C' || (col + 1) AS column_id, {_COLUMN} AS column_label, sure AS unit_confidence FROM w)"""
SQL["item_details"] = f"""WITH {ACCOUNTS}, node AS ({adapter.nodes_sql(duck=True)}), {CATALOGUE}, {COMPARED.split(CATALOGUE + ', ')[1].split(', opinion AS')[0]}, {OF_ROWS}, {SECTIONS}, {OF_CELLS}
SELECT corp, year, item, 'accounts' AS origin, value, raw_value, unit_multiplier, confidence, value_state, flags, source_type, fs_div, statement, account_id, account_nm, currency, column_id, column_label, {_BLANK} FROM ad
UNION ALL SELECT x.corp, x.year, x.item, 'document', value, raw_value, unit_multiplier, coalesce(confidence, 'missing'), coalesce(value_state, 'missing'), coalesce(flags, 'not_found'), 'document_xml', NULL, x.statement, NULL, NULL, NULL, column_id, column_label,
  NULL, table_id, row_id, row_label, normalized_row_label, unit_confidence FROM (SELECT corp, year, item, statement FROM facts, cat) x LEFT JOIN dd USING (corp, year, item)"""
_SAID = "coalesce(format('{:.0f}', ours), '-') || ' vs ' || coalesce(format('{:.0f}', theirs), '-')"
SQL["final_details"] = f"""{COMPARED}, {OF_ROWS}, fin AS (SELECT corp, year, item, ours, theirs, CASE WHEN disagree AND item = 'assets' AND year % 3 = 0 THEN NULL WHEN NOT disagree THEN ours WHEN item = 'revenue' THEN coalesce(theirs, ours) WHEN item = 'gross' THEN ours
    WHEN theirs IS NULL THEN ours ELSE coalesce(theirs * 2, ours) END AS final FROM cmp),
  j AS (SELECT ad.*, ours, theirs, final, f.item IS NULL OR (value IS NULL AND final IS NULL) OR coalesce(abs(value - final) <= greatest(1, abs(value), abs(final)) * 1e-12, false) AS same FROM ad LEFT JOIN fin f USING (corp, year, item))
SELECT corp, year, item, CASE WHEN same THEN value ELSE final END AS value, CASE WHEN same THEN raw_value END AS raw_value, CASE WHEN same THEN unit_multiplier END AS unit_multiplier,
  CASE WHEN same THEN confidence WHEN final IS NULL THEN 'missing' ELSE 'unverified_ai_value' END AS confidence, CASE WHEN same THEN value_state WHEN final IS NULL THEN 'missing' ELSE 'extracted' END AS value_state,
  CASE WHEN same THEN flags WHEN final IS NULL THEN 'final_value_removed_by_ai_comparison' ELSE 'ai_numeric_without_source' END AS flags, CASE WHEN same THEN 'dart_api' ELSE 'ai_comparison' END AS source_type,
  {', '.join(f'CASE WHEN same THEN {c} END AS {c}' for c in ('fs_div', 'statement', 'account_id', 'account_nm', 'currency', 'column_id'))}, CASE WHEN NOT same THEN 'adjudicated' END AS ai_source,
  CASE WHEN NOT same AND final IS NOT NULL THEN {_SAID} END AS disagreement, corp || '-' || year AS rcept_no, '사업보고서' AS report_nm, 'A' AS path, 'annual' AS report_type FROM j"""

#: Reports of audits look at all cash-flow tables.
_LOOSE = BUCKETS.replace("WHERE matched OR NOT any_own)", "WHERE matched OR NOT any_own OR (corp, year) IN (SELECT (corp, year) FROM facts WHERE k > 2))")
_DIVISION = f"""{DIVISION.replace('division AS (', 'told AS (')}, division AS (SELECT corp, year, CASE WHEN k IN (0, 3) THEN 'CFS' WHEN k IN (1, 4) THEN 'OFS' ELSE fs_div END AS fs_div, scope FROM told JOIN facts USING (corp, year))"""
SQL["analysis_run"] = f"""WITH {ACCOUNTS}, node AS ({adapter.nodes_sql(duck=True)}), {CATALOGUE}, {EXTRACT.replace('), found AS (', '), of_rows AS (')}, of_docs AS ({DOCS['doc_extract']}),
found AS (SELECT corp, year, item, amount FROM of_rows JOIN facts USING (corp, year) WHERE k <> 2 AND k < 3 UNION ALL SELECT corp, year, item, value FROM of_docs JOIN facts USING (corp, year) WHERE k >= 2), {WIDE},
divided AS MATERIALIZED (WITH {_DIVISION} SELECT * FROM division), buckets AS MATERIALIZED (WITH {_DIVISION}, {_LOOSE} SELECT * FROM bucket),
dep AS (SELECT corp, year, depr AS d, rou AS r, amort AS a, combined FROM buckets WHERE coalesce(depr, rou, amort) IS NOT NULL), {MERGED}, {CHECKED},
filed AS (SELECT corp, year, k FROM facts JOIN supplier ON s_name = corp WHERE (qty // 10000 + year) % 11 <> 0 AND s_suppkey % 10 <> 3),
grid AS (SELECT name, y.year, st FROM (SELECT s_name AS name, CASE WHEN s_suppkey % 10 = 3 THEN 'ambiguous_corp' ELSE 'ok' END AS st FROM supplier UNION ALL SELECT 'nobody', 'no_corp') n, (SELECT DISTINCT year FROM facts) y)
SELECT g.name, g.year, CASE WHEN st <> 'ok' THEN st WHEN r.k IS NULL THEN 'no_report' WHEN f.is_valid IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN r.k < 3 THEN 'A' WHEN r.k >= 3 THEN 'B' END AS path, CASE WHEN r.k IS NOT NULL THEN fs_div END AS fs_div,
  CASE WHEN r.k IS NOT NULL THEN revenue END AS revenue, CASE WHEN r.k IS NOT NULL THEN op_income END AS op_income, CASE WHEN r.k IS NOT NULL THEN f.depr END AS depr, CASE WHEN r.k IS NOT NULL THEN f.rou END AS rou, CASE WHEN r.k IS NOT NULL THEN f.amort END AS amort,
  CASE WHEN r.k IS NOT NULL THEN {EBITDA.replace('depr', 'f.depr').replace('rou', 'f.rou').replace('amort', 'f.amort')} END AS ebitda, CASE WHEN r.k IS NOT NULL THEN is_valid END AS is_valid, CASE WHEN r.k IS NOT NULL THEN array_to_string(flags, ' / ') END AS flags,
  CASE WHEN r.k IS NULL THEN NULL WHEN f.combined THEN '감가상각비란에 ''감가상각비 및 무형자산상각비'' 합산액 기입 (원본에서 분리 불가)' WHEN r.k = 2 THEN '사업보고서 본문 파싱으로 추출 (XBRL 미등록)' END AS remarks,
  CASE WHEN r.k IS NOT NULL AND dep.d IS NOT NULL OR r.k IS NOT NULL AND dep.r IS NOT NULL OR r.k IS NOT NULL AND dep.a IS NOT NULL THEN 'cf' END AS depr_source
FROM grid g LEFT JOIN filed r ON r.corp = name AND r.year = g.year LEFT JOIN divided v ON v.corp = name AND v.year = g.year LEFT JOIN flagged f ON f.corp = name AND f.year = g.year LEFT JOIN dep ON dep.corp = name AND dep.year = g.year"""
