"""Plain SQL of the queries over document nodes."""

from __future__ import annotations

from . import adapter
from . import oracle_words as words
from .oracle import CATALOGUE, NODES, cell_amount, contains_any, gone, label, listed, note_amount, quoted, row_label, title_core, trim, unit

TITLE = gone("title_text", f"{words.WS}+")
CORE = title_core("title_text")
FLAT = trim("replace(c, ' ', '')")

SECTION = "CASE " + " ".join(f"WHEN contains({TITLE}, {quoted(w)}) THEN '{s}'" for w, s in words.SECTIONS) + " END"
SECTIONS = f"sec AS (SELECT * FROM (SELECT *, last_value(CASE WHEN kind = 'title' THEN {SECTION} END IGNORE NULLS) OVER (PARTITION BY corp, year ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM node) WHERE kind = 'table' AND section IS NOT NULL)"

BY_LABELS = f"CASE WHEN list_has_any(list_transform(rows, lambda r: {label('r[1]')}), {listed(words.BS_WORDS)}) THEN 'BS' WHEN list_has_any(list_transform(rows, lambda r: {label('r[1]')}), {listed(words.IS_WORDS)}) THEN 'IS' ELSE 'unknown' END"
#: tab: tables by title, and by their labels where titles give a document neither BS nor IS.
STATEMENTS = f"{SECTIONS}, lab AS (SELECT *, {BY_LABELS} AS section FROM node WHERE kind = 'table' AND (corp, year) NOT IN (SELECT (corp, year) FROM sec WHERE section IN ('BS', 'IS'))), tab AS (SELECT * FROM sec UNION ALL SELECT * FROM lab WHERE section <> 'unknown')"


#: cur(corp, year, pos, cur) over CTE tab; totals tells whether a lone total column counts.
def current(totals: bool) -> str:
    last = "WHEN tj IS NOT NULL THEN tj" if totals else ""
    return f"""
hr AS (SELECT corp, year, pos, i, rows[i] AS r, list_max(list_transform(rows, lambda x: len(x))) AS width FROM tab, unnest(range(1, least(5, len(rows)) + 1)) AS u(i)),
hc AS (SELECT corp, year, pos, i, j - 1 AS j, r[j] AS c, len(r) AS n, width FROM hr, unnest(range(1, len(r) + 1)) AS u(j)),
fc AS (SELECT *, {FLAT} AS f FROM hc),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, pos ORDER BY i, j) AS o FROM fc WHERE contains(f, '당기') AND NOT contains(f, '전기')) WHERE o = 1),
fin AS (SELECT now.corp, now.year, now.pos, coalesce(min(fc.j), any_value(now.n)) AS e FROM now LEFT JOIN fc ON fc.corp = now.corp AND fc.year = now.year AND fc.pos = now.pos AND fc.i = now.i AND fc.j > now.j AND contains(fc.f, '전기') GROUP BY 1, 2, 3),
tot AS (SELECT * FROM (SELECT fc.corp, fc.year, fc.pos, fc.j + greatest(fc.width - fc.n, 0) AS col, row_number() OVER (PARTITION BY fc.corp, fc.year, fc.pos ORDER BY fc.i, fc.j) AS o
  FROM fc JOIN now ON fc.corp = now.corp AND fc.year = now.year AND fc.pos = now.pos JOIN fin ON fin.corp = now.corp AND fin.year = now.year AND fin.pos = now.pos
  WHERE fc.f IN ('합계', '총계') AND fc.j > now.j AND (fc.n > now.n OR fc.j < e)) WHERE o = 1),
term AS (SELECT corp, year, pos, j FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, pos ORDER BY CAST(regexp_extract(c, '제[ \\t]*([0-9]+)[ \\t]*기', 1) AS INT) DESC, j) AS o FROM fc WHERE regexp_matches(c, '제[ \\t]*([0-9]+)[ \\t]*기')) WHERE o = 1),
yr AS (SELECT corp, year, pos, j FROM (SELECT corp, year, pos, j, row_number() OVER (PARTITION BY corp, year, pos ORDER BY CAST(y AS INT) DESC, j) AS o FROM fc, unnest(regexp_extract_all(c, '20[0-9][0-9]')) AS u(y)) WHERE o = 1),
lone AS (SELECT corp, year, pos, j AS tj FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, pos ORDER BY i, j) AS o FROM fc WHERE f IN ('합계', '총계')) WHERE o = 1),
cur AS (SELECT tab.corp, tab.year, tab.pos, CASE WHEN now.j IS NOT NULL THEN coalesce(tot.col, now.j) WHEN term.j IS NOT NULL THEN term.j WHEN yr.j IS NOT NULL THEN yr.j {last} END AS cur
  FROM tab LEFT JOIN now USING (corp, year, pos) LEFT JOIN tot USING (corp, year, pos) LEFT JOIN term USING (corp, year, pos) LEFT JOIN yr USING (corp, year, pos) LEFT JOIN lone USING (corp, year, pos))"""


TABLES = "tab AS (SELECT * FROM node WHERE kind = 'table')"
_FIRST = lambda xs: f"list_filter(list_transform({xs}, lambda x: {unit('x')}), lambda u: u IS NOT NULL)[1]"
UNITS = f"un AS (SELECT corp, year, pos, coalesce({_FIRST('prev_texts[1:5]')}, {_FIRST('flatten(rows[1:5])')}, 1) AS unit, CASE WHEN {_FIRST('prev_texts[1:5]')} IS NOT NULL THEN 'detected_from_tag' WHEN {_FIRST('flatten(rows[1:5])')} IS NOT NULL THEN 'detected_from_rows' ELSE 'assumed_won' END AS sure FROM tab)"
_NUMBERS = lambda f: f"list_filter(list_transform(range(2, len(r) + 1), lambda q: {{'j': q - 1, 'v': {f('r[q]')}}}), lambda z: z.v IS NOT NULL)"
ROWS = "tr AS (SELECT t.corp, t.year, t.pos, k2 AS row_no, rows[k2] AS r, rows[1] AS head, cur, unit, sure FROM tab t JOIN cur USING (corp, year, pos) JOIN un USING (corp, year, pos), unnest(range(1, len(rows) + 1)) AS u(k2))"
VALUED = f"tv AS (SELECT *, {row_label('r[1]')} AS label, {note_amount('r[cur + 1]')} AS here, ({_NUMBERS(note_amount)})[1].v AS first_number FROM tr), lr AS (SELECT *, coalesce(CASE WHEN cur < len(r) THEN here END, first_number) * unit AS value FROM tv)"

_MEANINGFUL = f"list_bool_or(list_transform(rows, lambda r: list_contains({listed(words.TOTALS)}, {label('r[1]')}) AND coalesce(list_bool_or(list_transform(r[2:], lambda c: coalesce({cell_amount('c')} <> 0, false))), false)))"
DIVISION = f"""inside AS (SELECT *, last_value(CASE WHEN kind = 'title' AND {contains_any(TITLE, [*words.STATEMENT_TITLES, '재무제표'])} THEN contains({TITLE}, '연결') END IGNORE NULLS)
    OVER (PARTITION BY corp, year ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS con_now, kind = 'title' AND {contains_any(TITLE, words.SCOPE_TITLES)} AS scoped, contains({TITLE}, '연결') AS con FROM node),
division AS (SELECT corp, year, CASE WHEN bool_or(coalesce(con_now AND kind = 'table' AND {_MEANINGFUL}, false)) THEN 'CFS' ELSE 'OFS' END AS fs_div,
  CASE WHEN bool_or(scoped AND con) AND NOT bool_or(scoped AND NOT con) THEN true WHEN bool_or(scoped AND NOT con) AND NOT bool_or(scoped AND con) THEN false END AS scope FROM inside GROUP BY corp, year)"""

_OVER = "OVER (PARTITION BY corp, year ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CASH_FLOW = f"""cf1 AS (SELECT node.*, division.fs_div, division.scope, {CORE} AS core, {TITLE} AS t FROM node JOIN division USING (corp, year)),
cf2 AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'title' AND core IN {tuple(words.NOTES_ROOTS)} THEN true WHEN kind = 'title' AND core IN {tuple(words.STATEMENT_ROOTS)} THEN false END IGNORE NULLS) {_OVER}, false) AS in_notes FROM cf1),
cf3 AS (SELECT *, CASE WHEN core IN {tuple(words.NOTES_ROOTS)} THEN false WHEN core IN {tuple(words.STATEMENT_ROOTS)} THEN contains(core, '현금흐름표') WHEN in_notes THEN false ELSE contains(t, '현금흐름표') END AS is_cf FROM cf2),
cf4 AS (SELECT *, count(*) FILTER (WHERE kind = 'title') {_OVER} AS tn FROM cf3),
lt AS (SELECT corp, year, tn, is_cf AS cf, CASE WHEN is_cf THEN CASE WHEN contains(core, '연결') THEN true WHEN contains(core, '별도') THEN false ELSE coalesce(scope, false) END END AS of FROM cf4 WHERE kind = 'title'),
cf5 AS (SELECT n.*, coalesce(lt.cf, false) AS cf, lt.of AS of FROM cf4 n LEFT JOIN lt ON n.corp = lt.corp AND n.year = lt.year AND n.tn = lt.tn WHERE kind = 'table'),
cf6 AS (SELECT *, coalesce(of = (fs_div = 'CFS'), true) AS matched FROM cf5 WHERE (cf OR NOT in_notes) AND (cf OR list_bool_or(list_transform(rows[1:10], lambda r: {contains_any("replace(r[1], ' ', '')", words.CF_MARKERS)})))),
tab AS (SELECT * FROM (SELECT *, bool_or(matched) OVER (PARTITION BY corp, year) AS any_own FROM cf6) WHERE matched OR NOT any_own)"""

_CLASS = "CASE WHEN contains(label, '누계') THEN NULL WHEN contains(label, '감가상각') AND contains(label, '무형자산상각') THEN 'combined' WHEN contains(label, '사용권자산상각') OR contains(label, '사용권자산감가상각') THEN 'rou' WHEN contains(label, '무형자산상각') THEN 'amort' WHEN contains(label, '감가상각') THEN 'general' END"
BUCKETS = f"""{CASH_FLOW.replace("tab AS (", "cft AS (")}, tab AS (SELECT * FROM cft WHERE contains(array_to_string(flatten(rows), ' '), '감가상각')), {UNITS}, {current(True)}, {ROWS}, {VALUED},
kl AS (SELECT *, {_CLASS} AS cls, pos * 1000 + row_no AS o FROM lr), v AS (SELECT * FROM kl WHERE cls IS NOT NULL AND value IS NOT NULL),
agg AS (SELECT corp, year, min_by(value, o) FILTER (WHERE cls = 'rou') AS rou, min_by(value, o) FILTER (WHERE cls = 'amort') AS amort, min_by(value, o) FILTER (WHERE cls = 'combined') AS joint, min(o) FILTER (WHERE cls = 'combined') AS pc, min(o) FILTER (WHERE cls = 'general') AS pg, min(pos) FILTER (WHERE cls = 'general') AS gp FROM v GROUP BY corp, year),
bucket AS (SELECT agg.corp, agg.year, CASE WHEN pc IS NOT NULL AND (pg IS NULL OR pc < pg) THEN joint ELSE (SELECT sum(value) FROM v WHERE v.corp = agg.corp AND v.year = agg.year AND v.pos = gp AND cls = 'general') END AS depr, rou, amort, pc IS NOT NULL AND (pg IS NULL OR pc < pg) AS combined FROM agg)"""

_NUM = f"list_bool_or(list_transform(r[2:], lambda c: {note_amount('c')} IS NOT NULL))"
_NAME = row_label("r[1]")
NOTES = f"""tt AS (SELECT corp, year, pos, {CORE} AS core, row_number() OVER (PARTITION BY corp, year ORDER BY pos) AS n FROM node WHERE kind = 'title'),
tf AS (SELECT corp, year, bool_or(core IN ('연결재무제표주석', '연결주석')) AS con, bool_or(core IN ('별도재무제표주석', '별도주석')) AS sep FROM tt GROUP BY corp, year),
st AS (SELECT corp, year, 0 AS n, false AS inside, CAST(NULL AS BOOLEAN) AS sc, false AS scoped FROM tf
  UNION ALL
  SELECT s.corp, s.year, s.n + 1,
    CASE WHEN core IN {tuple(words.NOTES_ROOTS)} THEN true WHEN core IN {tuple(words.STATEMENT_ROOTS)} THEN false ELSE inside END,
    CASE WHEN core IN ('연결재무제표주석', '연결주석') THEN true WHEN core IN ('별도재무제표주석', '별도주석') THEN false WHEN core = '재무제표주석' THEN false
      WHEN core = '주석' THEN CASE WHEN inside THEN sc WHEN con AND NOT sep THEN false WHEN sep AND NOT con THEN true ELSE coalesce(sc, scope) END
      WHEN core IN {tuple(words.STATEMENT_ROOTS)} THEN NULL ELSE sc END,
    scoped OR coalesce(core IN ('연결재무제표주석', '연결주석', '별도재무제표주석', '별도주석', '재무제표주석')
      OR (core = '주석' AND (CASE WHEN inside THEN sc WHEN con AND NOT sep THEN false WHEN sep AND NOT con THEN true ELSE coalesce(sc, scope) END) IS NOT NULL), false)
  FROM st s JOIN tt ON tt.corp = s.corp AND tt.year = s.year AND tt.n = s.n + 1 JOIN tf ON tf.corp = s.corp AND tf.year = s.year JOIN division d ON d.corp = s.corp AND d.year = s.year),
cand AS (SELECT node.*, st.sc, st.scoped, d.fs_div = 'CFS' AS want, d.scope AS doc_scope FROM (SELECT *, count(*) FILTER (WHERE kind = 'title') {_OVER} AS tn FROM node) node
  JOIN st ON st.corp = node.corp AND st.year = node.year AND st.n = node.tn JOIN division d ON d.corp = node.corp AND d.year = node.year
  WHERE kind = 'table' AND inside AND contains(array_to_string(flatten(rows), ' '), '감가상각') AND NOT {contains_any("array_to_string(flatten(rows[1:3]), ' ')", words.EXCLUDED_HEADERS)}
    AND list_bool_or(list_transform(rows, lambda r: {_NUM} AND NOT contains({_NAME}, '누계') AND ({_NAME} IN {tuple(words.EXACT_DEPR)} OR (contains({_NAME}, '감가상각비') AND contains({_NAME}, '무형자산상각비')))))
    AND NOT {contains_any("coalesce(list_filter(list_transform(prev_texts, lambda x: regexp_extract(x, '^([0-9]+[.]?[ ]*.{2,40})', 1)), lambda x: x <> '')[1], '')", words.PARTIAL_TITLES)}),
cw AS (SELECT *, bool_or(coalesce(sc = want, false)) OVER w AS any_own, bool_or(sc IS NULL) OVER w AS any_open FROM cand WINDOW w AS (PARTITION BY corp, year)),
kept AS (SELECT *, row_number() OVER (PARTITION BY corp, year ORDER BY pos) AS table_no FROM cw
  WHERE CASE WHEN any_own THEN coalesce(sc = want, false) WHEN coalesce(doc_scope = want, false) THEN sc IS NULL WHEN NOT scoped THEN sc IS NULL OR NOT any_open ELSE false END)"""

SELECTION = "sel AS (SELECT corp, year, slot, table_no, CASE slot WHEN 'depr' THEN CASE WHEN year % 3 = 0 THEN 99 WHEN table_no = 2 THEN 3 ELSE 3 END WHEN 'rou' THEN 5 ELSE 6 END AS row_no, year % 4 = 0 AS combined FROM facts, (VALUES ('depr'), ('rou'), ('amort')) AS s(slot), (SELECT 1 AS table_no) AS one)"

SQL = {
    "section_assign": f"WITH {NODES}, {SECTIONS} SELECT corp, year, pos, section, {BY_LABELS} AS by_labels FROM sec",
    "scope_infer": f"WITH {NODES}, {DIVISION} SELECT * FROM division",
    "current_column": f"WITH {NODES}, {TABLES}, {current(True)} SELECT corp, year, pos, CAST(cur AS INT) AS cur, (SELECT string_agg(c, ' / ' ORDER BY o) FROM (SELECT c, min(i) AS o FROM (SELECT i, {trim(gone('hc.c', words.WS + '+', ' '))} AS c FROM hc WHERE hc.corp = cur.corp AND hc.year = cur.year AND hc.pos = cur.pos AND hc.j = cur.cur) WHERE c <> '' AND {cell_amount('c')} IS NULL GROUP BY c)) AS column_label FROM cur",
    "doc_extract": f"""WITH {NODES}, {CATALOGUE}, {STATEMENTS}, {UNITS}, {current(False)}, {ROWS},
      kw AS (SELECT item, statement, negated, unnest(keywords) AS word FROM cat),
      m AS (SELECT tr.*, item, negated, word, {cell_amount('r[cur + 1]')} AS here, cur IS NOT NULL AND cur < len(r) AS known,
        list_filter({_NUMBERS(cell_amount)}, lambda z: NOT contains({gone('coalesce(head[z.j + 1], chr(32))', words.WS + '+')}, '주석'))[1].v AS fst FROM tr JOIN tab USING (corp, year, pos) JOIN kw ON statement = section AND word = {label('r[1]')}),
      v AS (SELECT *, CASE WHEN known THEN coalesce(here, 0) ELSE fst END * unit AS v0 FROM m), p AS (SELECT *, CASE WHEN item = 'cogs' THEN abs(v0) WHEN list_contains(negated, word) AND v0 > 0 THEN -v0 ELSE v0 END AS value FROM v WHERE v0 IS NOT NULL)
      SELECT corp, year, item, value, CASE WHEN known AND here IS NOT NULL AND sure <> 'assumed_won' THEN 'verified' ELSE 'low_confidence' END AS confidence, CAST(unit AS BIGINT) AS unit FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, item ORDER BY pos, row_no) AS o FROM p) WHERE o = 1""",
    "cf_tables": f"WITH {NODES}, {DIVISION}, {CASH_FLOW} SELECT corp, year, pos, matched FROM tab",
    "cf_buckets": f"WITH {NODES}, {DIVISION}, {BUCKETS} SELECT * FROM bucket",
    "notes_candidates": f"WITH RECURSIVE {NODES}, {DIVISION}, {NOTES} SELECT corp, year, pos, CAST(table_no AS INT) AS table_no FROM kept",
    "position_verify": f"""WITH RECURSIVE {NODES}, {DIVISION}, {NOTES}, {SELECTION}, tab AS (SELECT * FROM kept), {UNITS}, {current(True)}, {ROWS}, {VALUED},
      l2 AS (SELECT lr.*, table_no, CASE WHEN cur IS NULL THEN first_number WHEN cur < len(r) THEN here ELSE first_number END * unit AS at_pos FROM lr JOIN kept USING (corp, year, pos)),
      g AS (SELECT corp, year, table_no, sum(value) AS total FROM l2 WHERE contains(label, '감가상각') AND NOT {contains_any('label', ['누계', '사용권', '무형자산상각'])} AND value IS NOT NULL GROUP BY ALL),
      x AS (SELECT sel.corp, sel.year, slot, combined, CASE WHEN slot = 'depr' AND contains(label, '감가상각비') AND contains(label, '무형자산상각비') THEN at_pos WHEN slot = 'depr' AND label IN {tuple(words.EXACT_DEPR)} THEN coalesce(total, at_pos)
        WHEN slot = 'rou' AND NOT combined AND label IN {tuple(words.EXACT_ROU)} THEN at_pos WHEN slot = 'amort' AND NOT combined AND label IN {tuple(words.EXACT_AMORT)} THEN at_pos END AS value
        FROM sel LEFT JOIN l2 ON l2.corp = sel.corp AND l2.year = sel.year AND l2.table_no = sel.table_no AND l2.row_no = sel.row_no LEFT JOIN g ON g.corp = sel.corp AND g.year = sel.year AND g.table_no = sel.table_no)
      SELECT corp, year, max(value) FILTER (WHERE slot = 'depr') AS depr, max(value) FILTER (WHERE slot = 'rou') AS rou, max(value) FILTER (WHERE slot = 'amort') AS amort, bool_or(combined) AS combined FROM x GROUP BY corp, year""",
    "doc_text_bundle": f"""WITH {NODES}, {SECTIONS.replace('sec AS', 'tab AS')}, {UNITS},
      b AS (SELECT corp, year, pos, list_position(['BS', 'IS', 'CF'], section) AS o, '[' || section || '] (단위: ' || CASE u WHEN 1 THEN '원' WHEN 1000 THEN '천원' WHEN 1000000 THEN '백만원' WHEN 100000000 THEN '억원' ELSE u || '원' END || ')' ||
        coalesce((SELECT string_agg(chr(10) || n || ': ' || v, '' ORDER BY q) FROM (SELECT q, {label('rows[q][1]')} AS n, array_to_string(list_filter(rows[q][2:], lambda c: {trim('c')} <> ''), ' | ') AS v FROM unnest(range(1, len(rows) + 1)) AS z(q)) WHERE n <> '' AND v <> ''), '') AS block
        FROM (SELECT tab.*, CASE WHEN unit = 1 THEN coalesce({_FIRST('flatten(rows[1:5])')}, 1) ELSE unit END AS u FROM tab JOIN un USING (corp, year, pos) WHERE section IN ('BS', 'IS', 'CF')))
      SELECT corp, year, left(string_agg(block, chr(10) ORDER BY o, pos), 8000) AS text FROM b GROUP BY corp, year""",
    "notes_text_bundle": f"""WITH RECURSIVE {NODES}, {DIVISION}, {NOTES}, tab AS (SELECT * FROM kept), {UNITS},
      b AS (SELECT corp, year, table_no, '[TABLE T' || table_no || ']' || chr(10) || '[SECTION] ' || coalesce(list_filter(list_transform(prev_texts, lambda x: regexp_extract(x, '^([0-9]+[.]?[ ]*.{{2,40}})', 1)), lambda x: x <> '')[1], '-') || chr(10)
        || '[UNIT] ' || CASE unit WHEN 1 THEN '원' WHEN 1000 THEN '천원' WHEN 1000000 THEN '백만원' ELSE '억원' END || list_reduce(list_prepend('', list_transform(range(1, len(rows) + 1), lambda q: chr(10) || '[ROW R' || q || '] ' || array_to_string(rows[q], ' | '))), lambda a, b: a || b) AS block
        FROM tab JOIN un USING (corp, year, pos))
      SELECT corp, year, string_agg(block, chr(10) || chr(10) ORDER BY table_no) AS text FROM b GROUP BY corp, year""",
}

# What tables say of depreciation; the words are written out here once more, so that a wrong one in the engine shows.
_ANY = "coalesce(list_bool_or(list_transform(rows, lambda r: {} AND {})), false)"
_SAYS = {
    "exact": _ANY.format(_NUM, f"{_NAME} IN ('감가상각비', '감가상각비용')"),
    "amort": _ANY.format(_NUM, f"{_NAME} IN ('무형자산상각비', '무형자산상각비용', '무형자산상각')"),
    "combined": _ANY.format(_NUM, f"contains({_NAME}, '감가상각비') AND contains({_NAME}, '무형자산상각비') AND NOT contains({_NAME}, '누계')"),
}
SQL["depreciation_signals"] = f"WITH {NODES}, s AS (SELECT corp, year, pos, {', '.join(f'{v} AS {k}' for k, v in _SAYS.items())} FROM node WHERE kind = 'table') SELECT *, exact AND amort AS pair FROM s"
SQL["separate_pairs"] = SQL["notes_candidates"].rpartition("SELECT")[0] + f"SELECT corp, year, string_agg('T' || table_no, ', ' ORDER BY table_no) AS pairs FROM kept WHERE {_SAYS['exact']} AND {_SAYS['amort']} GROUP BY corp, year"

#: The same SQL over the filings of words.
WORD_NODES = f"facts AS ({adapter.words_sql(duck=True)}), node AS ({adapter.nodes_sql(True, adapter.WORD_NODES)})"
for _name, _of in {"word_sections": "section_assign", "word_scopes": "scope_infer", "word_cash_flow": "cf_tables", "word_candidates": "notes_candidates", "word_signals": "depreciation_signals", "word_doc_items": "doc_extract"}.items():
    SQL[_name] = SQL[_of].replace(NODES, WORD_NODES)
