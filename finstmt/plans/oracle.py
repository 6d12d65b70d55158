"""The registered queries once more, as plain SQL over the same tables."""

from __future__ import annotations

from . import adapter
from . import oracle_words as words

ACCOUNTS = f"facts AS ({adapter.FACTS}), acct AS ({adapter.accounts_sql(duck=True)})"
NODES = f"facts AS ({adapter.FACTS}), node AS ({adapter.nodes_sql(duck=True)})"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def gone(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def trim(x: str) -> str:
    return gone(x, f"^{words.WS}+|{words.WS}+$")


def label(x: str) -> str:
    for step in words.LABEL_STEPS:
        x = gone(x, step)
    return x


def title_core(x: str) -> str:
    return gone(gone(x, f"{words.WS}+"), r"^[0-9\-]+\.")


def row_label(x: str) -> str:
    """Each prefix goes unless nothing would be left."""
    start = trim(f"translate({x}, ' 　 ', '')")
    step = gone("a", words.ROW_PREFIX)
    fold = ", ".join(["'.'"] * 12)  # more prefixes than any label of these data has
    return f"list_reduce([{start}, {fold}], lambda a, b: CASE WHEN {step} = '' THEN a ELSE {step} END)"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {quoted(words.NUMBER)}) THEN TRY_CAST({x} AS DOUBLE) END"


def account_amount(x: str) -> str:
    t = trim(x)
    plain = trim(f"replace({t}, ',', '')")
    return f"CASE WHEN {t} NOT IN ('', '-', 'N/A') THEN {number(plain)} END"


def cell_amount(x: str) -> str:
    t = trim(x)
    plain = f"replace({t}, ',', '')"
    signed = f"CASE WHEN {plain} LIKE '(%)' THEN '-' || {plain}[2:-2] ELSE {plain} END"
    return f"CASE WHEN {t} NOT IN ('', '-', 'N/A') THEN {number(f'({signed})')} END"


def note_amount(x: str) -> str:
    t = trim(x)
    bare = f"replace(replace(CASE WHEN {t} LIKE '(%)' THEN {t}[2:-2] ELSE {t} END, ',', ''), ' ', '')"
    return f"CASE WHEN {t} NOT IN ('', '-', '–', '—') THEN CASE WHEN {t} LIKE '(%)' THEN -({number(f'({bare})')}) ELSE {number(f'({bare})')} END END"


def unit(x: str) -> str:
    def value(pattern: str) -> str:
        token = f"upper({gone(f'regexp_extract({x}, {quoted(pattern)}, 1)', f'{words.WS}+')})"
        return f"CASE {token} WHEN 'KRW' THEN 1 " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in words.UNITS.items()) + " END"

    return f"coalesce({value(words.STRICT)}, {value(words.LOOSE)})"


def contains_any(x: str, words) -> str:
    return "coalesce(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ", false)"


CATALOGUE = "cat(item, name, statement, want, keywords, excluded, negated, item_no) AS (VALUES " + ", ".join(
    f"({quoted(i)}, {quoted(n)}, {quoted(s)}, {quoted(a) if a else 'NULL'}, {listed(k)}, {listed(x)}::VARCHAR[], {listed(g)}::VARCHAR[], {no})" for no, (i, n, s, a, k, x, g) in enumerate(words.ITEMS, 1)
) + ")"

EXTRACT = f"""
parsed AS (
  SELECT corp, year, pos, trim(account_id) AS id, replace(account_nm, ' ', '') AS nm, currency, {account_amount('thstrm_amount')} AS amount FROM acct
), cand AS (
  SELECT corp, year, item, pos, 1 AS stage, 0 AS kw, NULL AS keyword, amount, currency FROM parsed JOIN cat ON id = want WHERE amount IS NOT NULL
  UNION ALL
  SELECT corp, year, item, pos, 2, i, keywords[i], CASE WHEN list_contains(negated, keywords[i]) AND amount > 0 THEN -amount ELSE amount END, currency
  FROM parsed JOIN cat ON true, unnest(range(1, len(keywords) + 1)) AS u(i)
  WHERE amount IS NOT NULL AND contains(nm, keywords[i]) AND NOT coalesce(list_bool_or(list_transform(excluded, lambda x: contains(nm, x))), false)
), found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, item ORDER BY stage, pos, kw) AS n FROM cand) WHERE n = 1
)"""

WIDE = "wide AS (SELECT corp, year, " + ", ".join(f"max(amount) FILTER (WHERE item = '{i}') AS {i}" for i in words.NAMES) + " FROM found GROUP BY corp, year)"

#: Depreciation relation of the merge query: every second company has one, some of them combined.
DEPRECIATION = "dep AS (SELECT corp, year, CAST(qty + 1 AS DOUBLE) AS d, CAST(CASE WHEN k < 3 THEN -tax END AS DOUBLE) AS r, CAST(tax + 2 AS DOUBLE) AS a, k = 1 AS combined FROM facts WHERE k < 4)"

MERGED = """merged AS (
  SELECT w.corp, w.year, assets, liabilities, equity, retained, revenue, abs(cogs) AS cogs, gross, op_income, net_income,
    abs(coalesce(d, depr)) AS depr, CASE WHEN NOT coalesce(combined, false) THEN abs(coalesce(r, rou)) END AS rou,
    CASE WHEN NOT coalesce(combined, false) THEN abs(coalesce(a, amort)) END AS amort,
    coalesce(combined, false) AS combined, cogs < 0 AS cogs_turned
  FROM wide w LEFT JOIN dep USING (corp, year)
)"""
EBITDA = "op_income + coalesce(depr, 0) + coalesce(rou, 0) + coalesce(amort, 0)"

CHECKED = """chk AS (
  SELECT *, assets IS NULL OR liabilities IS NULL OR equity IS NULL AS skip1, gross IS NULL OR revenue IS NULL OR cogs IS NULL AS skip2, op_income IS NULL OR gross IS NULL AS skip3,
    abs(assets - (liabilities + equity)) AS d1, abs(gross - (revenue - cogs)) AS d2, greatest(op_income - gross, 0) AS d3 FROM merged
), val AS (
  SELECT *, skip1 OR d1 <= greatest(1, abs(assets) * 0.0001) AS p1, skip2 OR d2 <= greatest(1, abs(CASE WHEN gross <> 0 THEN gross ELSE revenue - cogs END) * 0.0001) AS p2,
    skip3 OR op_income <= gross AS p3 FROM chk
), flagged AS (
  SELECT *, p1 AND p2 AS is_valid,
    list_filter([CASE WHEN NOT p1 THEN '[CRITICAL] 회계항등식: 총자산 = 총부채 + 자본총계 | 차이=' || format('{:,}', CAST(d1 AS BIGINT)) || '원' END,
      CASE WHEN NOT p2 THEN '[CRITICAL] 회계항등식: 매출총이익 = 매출액 - 매출원가 | 차이=' || format('{:,}', CAST(d2 AS BIGINT)) || '원' END,
      CASE WHEN NOT p3 THEN '[WARNING] 논리검증: 영업이익 ≤ 매출총이익 | 차이=' || format('{:,}', CAST(d3 AS BIGINT)) || '원' END], lambda x: x IS NOT NULL) AS flags FROM val
)"""
RESULTS = f"WITH {ACCOUNTS}, {CATALOGUE}, {EXTRACT}, {WIDE}, {DEPRECIATION}, {MERGED}, {CHECKED}"


def eok(x: str) -> str:
    v = f"format('{{:,}}', CAST(round_even(abs({x} / 1e8), 0) AS BIGINT))"
    return f"CASE WHEN {x} IS NULL THEN '-' WHEN {x} < 0 THEN '(' || {v} || ')' ELSE {v} END"


OPINION = """opinion AS (
  SELECT corp, year, item, CASE WHEN length(item) % 3 = 0 THEN amount + 0.5 WHEN length(item) % 3 = 1 AND year % 2 = 0 THEN amount * 1.01 ELSE amount END AS value FROM found WHERE item <> 'gross'
  UNION ALL SELECT corp, year, 'rou', CAST(7 AS DOUBLE) FROM facts WHERE k = 0
), cmp AS (
  SELECT coalesce(f.corp, o.corp) AS corp, coalesce(f.year, o.year) AS year, coalesce(f.item, o.item) AS item, f.amount AS ours, o.value AS theirs,
    CASE WHEN f.amount IS NULL AND o.value IS NULL THEN false WHEN f.amount IS NULL OR o.value IS NULL THEN true
      ELSE abs(f.amount - o.value) > 1 AND abs(f.amount - o.value) / greatest(abs(f.amount), abs(o.value), 1) > 0.001 END AS disagree
  FROM found f FULL JOIN opinion o ON f.corp = o.corp AND f.year = o.year AND f.item = o.item
)"""
COMPARED = f"WITH {ACCOUNTS}, {CATALOGUE}, {EXTRACT}, {OPINION}"

SQL = {
    "ebitda": f"{RESULTS} SELECT corp, year, op_income, depr, rou, amort, {EBITDA} AS ebitda FROM merged",
    "account_extract": f"WITH {ACCOUNTS}, {CATALOGUE}, {EXTRACT} SELECT corp, year, item, amount AS value, CASE stage WHEN 1 THEN 'account_id' ELSE 'account_nm' END AS method, keyword, CASE WHEN stage = 2 OR currency <> 'KRW' THEN 'low_confidence' ELSE 'verified' END AS confidence FROM found",
    "depreciation_merge": f"{RESULTS} SELECT corp, year, cogs, depr, rou, amort, CASE WHEN combined THEN '감가상각비란에 ''감가상각비 및 무형자산상각비'' 합산액 기입 (원본에서 분리 불가)' END AS remarks FROM merged",
    "identity_checks": f"{RESULTS} SELECT corp, year, p1 AS balance_passed, p2 AS gross_passed, p3 AS operating_passed, CASE WHEN NOT skip1 THEN d1 END AS balance_diff, CASE WHEN NOT skip2 THEN d2 END AS gross_diff, is_valid, array_to_string(flags, ' / ') AS flags FROM flagged",
    "summary_report": f"{RESULTS} SELECT corp, year, " + ", ".join(f"{eok(i)} AS {i}" for i in words.NAMES) + f", {eok('(' + EBITDA + ')')} AS ebitda, CASE WHEN is_valid THEN '✓ 통과' ELSE '✗ 검증실패' END AS status, CASE WHEN len(flags) = 0 THEN '실패한 검증은 없습니다.' ELSE array_to_string(flags, ' | ') END AS detail FROM flagged",
    "run_metrics": f"{RESULTS} SELECT count(*) AS n_total, CAST(sum(" + " + ".join(f"CAST({i} IS NOT NULL AS INT)" for i in words.NAMES) + ") AS BIGINT) AS n_items, count(*) FILTER (WHERE is_valid) AS n_valid, count(*) FILTER (WHERE NOT is_valid) AS n_invalid FROM flagged",
    "company_pivot": f"WITH {ACCOUNTS}, {CATALOGUE}, {EXTRACT} SELECT corp, item, " + ", ".join(f'max(amount) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1995, 2002)) + " FROM found GROUP BY corp, item",
    "fs_div_infer": f"""WITH {ACCOUNTS}, d AS (SELECT corp, year, upper(trim(fs_div)) AS div, count(*) AS n, min(pos) AS first FROM acct GROUP BY ALL),
      b AS (SELECT corp, year, div FROM (SELECT *, row_number() OVER (PARTITION BY corp, year ORDER BY n DESC, first) AS r FROM d WHERE div IN ('CFS', 'OFS')) WHERE r = 1),
      c AS (SELECT corp, year, min_by(currency, pos) FILTER (WHERE currency <> 'KRW') AS non_krw FROM acct GROUP BY corp, year)
      SELECT corp, year, coalesce(div, 'CFS') AS fs_div, non_krw FROM c LEFT JOIN b USING (corp, year)""",
    "ai_text_bundle": f"""WITH {ACCOUNTS}, l AS (SELECT corp, year, pos, CASE sj_div WHEN 'CIS' THEN 'IS' ELSE sj_div END AS section, trim(account_nm) || ': ' || trim(thstrm_amount) AS line FROM acct WHERE trim(coalesce(thstrm_amount, '')) NOT IN ('', '-')),
      s AS (SELECT corp, year, section, '[' || section || ']' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS block FROM l GROUP BY corp, year, section)
      SELECT corp, year, left(t, 8000) AS text FROM (SELECT corp, year, string_agg(block, chr(10) ORDER BY list_position(['BS', 'IS', 'CF', 'SCE'], section)) AS t FROM s GROUP BY corp, year)""",
    "ai_compare": f"""{COMPARED} SELECT corp, year, item, ours, theirs, disagree, CASE WHEN NOT disagree THEN ours WHEN item = 'revenue' THEN coalesce(theirs, ours) WHEN item = 'gross' THEN ours
      WHEN theirs IS NULL THEN ours ELSE coalesce(theirs * 2, ours) END AS final FROM cmp""",
    "ai_outcome": f"""{COMPARED}, n AS (SELECT corp, year, count(*) FILTER (WHERE disagree) AS n, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE disagree), '') AS items FROM cmp GROUP BY corp, year)
      SELECT corp, year, CASE WHEN k = 3 THEN 'python_fallback' WHEN n = 0 THEN 'agreed' WHEN k = 2 THEN 'ai_extract_only' ELSE 'adjudicated' END AS source,
      CASE WHEN k = 3 THEN 0 WHEN n = 0 THEN 1 WHEN k = 2 THEN 1 ELSE 2 END AS ai_calls, CASE WHEN k = 3 THEN '' ELSE items END AS disagreements FROM n JOIN facts USING (corp, year)""",
    "golden_diff": f"""{COMPARED} SELECT corp, year, item, ours AS actual, theirs AS golden, CASE WHEN o.item IS NULL THEN 'extra' WHEN f.item IS NULL THEN 'missing' ELSE 'differs' END AS kind
      FROM cmp c LEFT JOIN (SELECT corp, year, item FROM found) f USING (corp, year, item) LEFT JOIN (SELECT corp, year, item FROM opinion) o USING (corp, year, item)
      WHERE o.item IS NULL OR f.item IS NULL OR NOT abs(ours - theirs) <= greatest(1, abs(theirs) * 1e-6)""",
    "amount_parse": f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN '(' || format('{{:,}}', CAST(l_quantity AS BIGINT) * 12345) || ')' WHEN 1 THEN ' ' || format('{{:,}}', CAST(l_quantity AS BIGINT) * 1234) || ' '
        WHEN 2 THEN '-' WHEN 3 THEN '' WHEN 4 THEN 'N/A' WHEN 5 THEN '1 ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '—' END AS x FROM lineitem)
      SELECT l_orderkey, l_linenumber, {account_amount('x')} AS account, {cell_amount('x')} AS cell, {note_amount('x')} AS note FROM s""",
    "label_normalize": f"""WITH s AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'III. 영 업 이 익<주석' || p_size || '>' WHEN 1 THEN '(2)' || p_name || '(주' || p_size || ',31)' WHEN 2 THEN '가. ' || p_brand WHEN 3 THEN 'Ⅳ.　자\t산 총계.'
        WHEN 4 THEN p_size || '. ' || p_name WHEN 5 THEN '  ' WHEN 6 THEN '매출원가(주석15, 16 ,21)' ELSE p_type || '..' END AS x FROM part)
      SELECT p_partkey, {label('x')} AS label, {title_core('x')} AS core FROM s""",
    "row_label_normalize": f"""WITH s AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '1.가.감가상각비' WHEN 1 THEN '(' || p_size || ') 무형자산 상각비' WHEN 2 THEN '나) ' || p_name WHEN 3 THEN '①감가상각비' WHEN 4 THEN CAST(p_size AS VARCHAR)
        WHEN 5 THEN '( 가 ) 사용권자산상각비' WHEN 6 THEN '' ELSE '1)2)3)' || p_brand END AS x FROM part)
      SELECT p_partkey, {row_label('x')} AS label FROM s""",
    "unit_detect": f"""WITH t AS (SELECT doc_id, text, CASE doc_id % 8 WHEN 0 THEN '(단위: 백만원)' WHEN 1 THEN '금액 단위 ： [천 원]' WHEN 2 THEN '단위는 미화 기준 억원' WHEN 3 THEN '(단위:krw)' WHEN 4 THEN '단위 원' WHEN 5 THEN text WHEN 6 THEN '단위: 달러' ELSE '백만원' END AS x FROM documents),
      s AS (SELECT doc_id, CASE doc_id % 8 WHEN 5 THEN x ELSE x || ' ' || coalesce(text, '') END AS x FROM t)
      SELECT doc_id, CAST({unit('x')} AS BIGINT) AS unit FROM s""",
    "registry_search": """WITH names AS (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT DISTINCT s_name[1:17] FROM supplier UNION SELECT DISTINCT right(s_name, 3) FROM supplier UNION SELECT unnest(['nobody', 'S', '', '#00', 'upplier#000'])),
      reg AS (SELECT s_suppkey AS pos, 'C' || s_suppkey AS corp_code, s_name AS corp_name FROM supplier UNION ALL SELECT s_suppkey + 100000, 'D' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 10 = 3),
      ex AS (SELECT name, count(*) AS n, min_by(corp_code, pos) AS code FROM names JOIN reg ON name = corp_name GROUP BY name),
      h AS (SELECT name, array_to_string(list(corp_name ORDER BY pos)[1:3], '|') AS hints FROM names JOIN reg ON contains(corp_name, name) GROUP BY name)
      SELECT name, CASE WHEN n = 1 THEN code END AS corp_code, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous_corp' ELSE 'no_corp' END AS status,
        CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN (SELECT array_to_string(list(corp_name ORDER BY pos)[1:3], '|') FROM reg WHERE corp_name = name) ELSE hints END AS hints FROM names LEFT JOIN ex USING (name) LEFT JOIN h USING (name)""",
    "corp_year_grid": """SELECT n_name AS corp, y AS year, CASE WHEN n_nationkey % 5 = 0 THEN 'X' || n_nationkey ELSE 'N' || n_nationkey END AS corp_code
      FROM (SELECT * FROM nation ORDER BY n_name LIMIT 100), (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders)""",
    "report_choice": """WITH f AS (SELECT o_custkey AS corp, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A001' WHEN '2' THEN 'F002' WHEN '3' THEN 'F001' ELSE 'B001' END AS kind, o_orderkey AS pos,
        'R' || o_orderkey AS rcept_no, CASE o_orderkey % 3 WHEN 0 THEN '사업보고서' ELSE '사업보고서 (' || (year(o_orderdate) - o_orderkey % 2) || '.12)' END AS report_nm, strftime(o_orderdate, '%Y%m%d') AS rcept_dt FROM orders),
      y AS (SELECT DISTINCT o_custkey AS corp, CAST(year(o_orderdate) AS INT) AS year FROM orders),
      d AS (SELECT y.*, kind, rcept_no, report_nm, rcept_dt, CASE kind WHEN 'A001' THEN 1 WHEN 'F002' THEN 2 ELSE 3 END AS p, row_number() OVER (PARTITION BY y.corp, year, kind ORDER BY rcept_dt DESC, pos) AS n
        FROM f JOIN y USING (corp) WHERE kind <> 'B001' AND rcept_dt BETWEEN year || '0101' AND (year + 2) || '0630'),
      t AS (SELECT *, TRY_CAST(nullif(regexp_extract(report_nm, '\\(([0-9]{4})\\.[0-9]{2}\\)', 1), '') AS INT) AS ty FROM d WHERE n <= 10)
      SELECT corp, year, kind, rcept_no, report_nm, rcept_dt FROM (SELECT *, row_number() OVER (PARTITION BY corp, year ORDER BY p, n) AS b FROM t WHERE ty IS NULL OR ty = year) WHERE b = 1""",
    "semi_anti": """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_info FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "ordered_distinct": """WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities FROM p GROUP BY o_custkey""",
    "rate_window": """SELECT time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS n_calls, count(*) > 15 AS over_limit FROM events GROUP BY 1""",
}

SQL["disagreement_texts"] = f"{COMPARED} SELECT corp, year, item, coalesce(format('{{:.0f}}', ours), '-') || ' vs ' || coalesce(format('{{:.0f}}', theirs), '-') AS text FROM cmp WHERE disagree"
SQL["reply_values"] = f"""WITH facts AS ({adapter.FACTS}) SELECT corp, year, k < 3 AS parsed, CAST(CASE k WHEN 0 THEN qty WHEN 1 THEN tax END AS DOUBLE) AS depr,
  CAST(CASE k WHEN 1 THEN 1 WHEN 2 THEN rev END AS DOUBLE) AS amort FROM facts"""
SQL["status_texts"] = f"""WITH facts AS ({adapter.FACTS}), s AS (
  SELECT corp, year, year % 4 AS n, ['ok', 'no_corp', 'ambiguous_corp', 'no_report', 'error'][k + 1] AS state, ['', '유사: A', '보고서 탐색 오류: x', '재무데이터 추출 오류: y'][year % 4 + 1] AS message FROM facts)
SELECT corp, year, state, CASE state
    WHEN 'ok' THEN '데이터 추출 성공. 사용 보고서: ' || CASE WHEN n = 1 THEN '-' ELSE '사업보고서' END || ', 경로 ' || CASE WHEN n < 2 THEN 'A' ELSE 'B' END || ', 재무제표 기준 ' || CASE WHEN n IN (0, 2) THEN '연결' ELSE '별도' END || '.'
    WHEN 'no_report' THEN year || ' 사업연도 기준 사업보고서, 연결감사보고서, 감사보고서를 순서대로 찾았지만 사용 가능한 보고서를 찾지 못했습니다.'
    WHEN 'no_corp' THEN CASE n WHEN 0 THEN '기업명을 찾지 못했습니다.' ELSE message END || CASE WHEN n = 1 THEN '. 입력한 이름과 정확히 일치하는 DART 기업명이 없어 자동 선택하지 않았습니다. 동명이인이나 유사 상호가 많을 수 있으니 정식 법인명으로 다시 조회해 주세요.' ELSE '. DART 기업코드 목록에서 정확 일치 기업명을 찾지 못했습니다.' END
    WHEN 'ambiguous_corp' THEN CASE n WHEN 0 THEN '동일 기업명이 여러 개 존재합니다.' ELSE message END || ' DART에 같은 이름의 법인이 다수 등록되어 있어 재무데이터를 특정할 수 없습니다.'
    ELSE CASE n WHEN 0 THEN '분석 중 오류가 발생했습니다.' WHEN 2 THEN message || '. DART 공시 목록 조회 단계에서 실패했습니다.' WHEN 3 THEN message || '. 보고서는 찾았지만 재무 항목 추출 단계에서 실패했습니다.' ELSE message END END AS text,
  CASE WHEN state <> 'ok' THEN message WHEN n = 0 THEN '✓ 통과' WHEN n = 1 THEN '✗ 검증실패' ELSE '검증정보 없음' END AS status FROM s"""

#: Call by call: the state after each is the begin of its window and the calls in it.
SQL["call_waits"] = """WITH RECURSIVE c AS MATERIALIZED (SELECT event_type AS caller, event_id AS call_id, epoch_us(ts) // 600 AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 600, event_id) AS o FROM events),
  s AS (SELECT caller, call_id, o, t AS began, 1 AS n, 0.0::DOUBLE AS wait_s FROM c WHERE o = 1
    UNION ALL
    SELECT c.caller, c.call_id, c.o, CASE WHEN c.t - began >= 60000000 THEN c.t WHEN n >= 15 THEN c.t + 30000000 ELSE began END, CASE WHEN c.t - began >= 60000000 OR n >= 15 THEN 1 ELSE n + 1 END,
      CASE WHEN c.t - began < 60000000 AND n >= 15 THEN 30.0 ELSE 0.0 END::DOUBLE FROM s JOIN c ON c.caller = s.caller AND c.o = s.o + 1)
  SELECT caller, call_id, wait_s FROM s"""
SQL["newest_corrections"] = """SELECT corp, year, kind, rcept_no, report_nm, rcept_dt FROM (SELECT *, row_number() OVER (PARTITION BY corp, year, kind ORDER BY rcept_dt DESC, rcept_no DESC) AS o
  FROM (SELECT 'C' || o_custkey AS corp, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS kind, 'R' || o_orderkey AS rcept_no, o_orderstatus AS report_nm, strftime(o_orderdate, '%Y%m%d') AS rcept_dt FROM orders)) WHERE o = 1"""
SQL["registry_as_of"] = """WITH v(code, taken) AS (VALUES ('A', TIMESTAMP '2024-01-05 00:00:00'), ('B', TIMESTAMP '2024-01-05 12:00:00'), ('C', TIMESTAMP '2024-01-12 06:00:00')),
  e AS (SELECT event_id, ts, 'Supplier#' || lpad(CAST(user_id + 1 AS VARCHAR), 9, '0') AS name FROM events WHERE ts < TIMESTAMP '2024-01-20'),
  d AS (SELECT e.*, code, taken FROM e ASOF LEFT JOIN v ON e.ts >= v.taken),
  f AS (SELECT event_id, name, CASE WHEN ts < taken + INTERVAL 24 HOURS THEN taken END AS taken, CASE WHEN ts < taken + INTERVAL 24 HOURS THEN code END AS code FROM d)
  SELECT event_id, name, strftime(taken, '%Y-%m-%d %H:%M') AS taken_at, CASE WHEN taken IS NOT NULL THEN CASE WHEN s_suppkey IS NULL OR (code = 'A' AND s_suppkey % 3 = 0) THEN 0 WHEN code = 'B' AND s_suppkey % 5 = 0 THEN 2 ELSE 1 END END AS n_exact,
    CASE WHEN NOT (code = 'A' AND s_suppkey % 3 = 0) THEN code || s_suppkey END AS corp_code FROM f LEFT JOIN supplier ON s_name = name"""
_N = lambda x: f"format('{{:,}}', {x})"
SQL["html_tables"] = f"""WITH facts AS ({adapter.FACTS}) SELECT corp || '~' || year AS doc_id, r.t AS table_no, r.n AS row_no, r.c AS cells FROM (SELECT corp, year, unnest([{{'t': 1, 'n': 0, 'c': '상호|' || replace(corp, '#', ' ')}}, {{'t': 2, 'n': 0, 'c': '과목|금액|금액'}}, {{'t': 2, 'n': 1, 'c': '과목|당기|전기'}},
  {{'t': 2, 'n': 2, 'c': '자산 총계|' || {_N('qty * 3')} || '|-'}}, {{'t': 2, 'n': 3, 'c': 'Ⅱ.부채총계|' || {_N('qty')} || '|-'}}, {{'t': 2, 'n': 4, 'c': '결손금|(' || {_N('tax')} || ')|-'}}, {{'t': 2, 'n': 5, 'c': '주석|주석|주석'}}]) AS r FROM facts)"""
SQL["html_items"] = f"""WITH facts AS ({adapter.FACTS}) SELECT corp || '~' || year AS doc_id, r.i AS item, CAST(r.v AS DOUBLE) AS value FROM (SELECT corp, year, unnest([{{'i': 'assets', 'v': qty * 3000}}, {{'i': 'liabilities', 'v': qty * 1000}}, {{'i': 'retained', 'v': -tax * 1000}}]) AS r FROM facts)"""
SQL["word_items"] = SQL["account_extract"].replace(ACCOUNTS, f"facts AS ({adapter.words_sql(duck=True)}), acct AS ({adapter.accounts_sql(True, adapter.WORD_ACCOUNTS)})")
_SHOWN = ", ".join(f"{eok(f'CASE WHEN ok THEN {i} END')} AS {i}" for i in words.NAMES)
SQL["summary_states"] = f"""{RESULTS}, st AS (SELECT corp, year, ['ok', 'no_corp', 'ambiguous_corp', 'no_report', 'error', 'ok'][(k + year) % 6 + 1] AS state FROM facts), so AS (SELECT *, state = 'ok' AS ok FROM st)
  SELECT so.corp, so.year, {_SHOWN}, {eok('CASE WHEN ok THEN ' + EBITDA + ' END')} AS ebitda, CASE WHEN NOT ok THEN '이유: ' || state WHEN is_valid THEN '✓ 통과' ELSE '✗ 검증실패' END AS status,
    CASE WHEN NOT ok THEN '이유: ' || state WHEN len(flags) = 0 THEN '실패한 검증은 없습니다.' ELSE array_to_string(flags, ' | ') END AS detail FROM so JOIN flagged USING (corp, year)"""
SQL["text_functions"] = """WITH s AS (SELECT *, p_partkey % 6 AS n, CAST(p_size AS DOUBLE) AS z, round(CAST(p_retailprice AS DOUBLE)) AS p FROM part),
  t AS (SELECT *, CASE n WHEN 0 THEN NULL WHEN 1 THEN p * 1e6 WHEN 2 THEN -p * 1e6 WHEN 3 THEN p ELSE z END AS a FROM s),
  u AS (SELECT *, CASE n WHEN 4 THEN z * (1 + 1e-13) WHEN 5 THEN z + 0.01 ELSE a END AS b FROM t)
  SELECT p_partkey, CASE WHEN a IS NULL THEN 'None' WHEN abs(a) >= 1e8 THEN format('{:,.1f}', a / 1e8) || '억' ELSE format('{:,.0f}', a) END AS short,
    CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE abs(a - b) <= greatest(1, abs(a), abs(b)) * 1e-12 END AS same,
    CASE n WHEN 0 THEN 'trace' ELSE regexp_replace(p_name, '[ /:*?"<>|]+', '_', 'g') || '_' || regexp_replace(p_brand, '[ /:*?"<>|]+', '_', 'g') END AS file_part, trim(p_name) || '|' || trim(p_brand) || '|' || p_size AS lines FROM u"""
SQL["division_choice"] = """SELECT corp, year, request_no, fs_div, answer FROM (SELECT o_custkey AS corp, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS request_no, CASE WHEN o_orderkey % 3 = 0 THEN 'CFS' ELSE 'OFS' END AS fs_div, o_orderpriority AS answer,
  row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey % 3 <> 0, o_orderkey DESC) AS n FROM orders) WHERE n = 1"""
SQL["candidate_info"] = """WITH r AS (SELECT 'N' || (c_nationkey % 7) || '-' || (c_custkey % 50) AS corp_name, c_custkey FROM customer)
  SELECT corp_name, 'C' || c.c_custkey AS corp_code, CASE WHEN c.c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS induty_code, CASE WHEN c.c_custkey % 6 = 0 THEN c_name ELSE '' END AS ceo_nm, 'C' || min(c.c_custkey) OVER (PARTITION BY corp_name) AS first_code FROM r JOIN customer c USING (c_custkey)"""
SQL["landed_accounts"] = SQL["account_extract"].replace(ACCOUNTS, f"facts AS ({adapter.FACTS}), all_of AS ({adapter.accounts_sql(duck=True)}), acct AS (SELECT a.* FROM all_of a JOIN facts USING (corp, year) WHERE k <> 2)")
SQL["landed_registry"] = """SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS corp_code, s_name || ' & <x>' AS corp_name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS stock_code, '20240101' AS modify_date,
  CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 'Y' ELSE '' END AS corp_cls, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN s_name ELSE '' END AS ceo_nm FROM supplier"""
SQL["landed_filings"] = """SELECT corp, kind, CAST(n - 1 AS INT) AS pos, rcept_no, report_nm, rcept_dt FROM (SELECT 'C' || o_custkey AS corp, o_orderpriority AS kind, 'R' || o_orderkey AS rcept_no, o_orderstatus AS report_nm, strftime(o_orderdate, '%Y%m%d') AS rcept_dt,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 2"""
