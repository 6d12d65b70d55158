"""The words, names and patterns of the rules, written out once more for the SQL.

Fixed values all: the engine has its own in functions/, and nothing here is taken from there, so a wrong word on either
side shows as a difference.
"""

from __future__ import annotations

# Item, name, statement, account id, keywords in order, excluding words, negating keywords.
ITEMS = [
    ("assets", "총자산", "BS", "ifrs-full_Assets", ["자산총계", "총자산"], [], []),
    ("liabilities", "총부채", "BS", "ifrs-full_Liabilities", ["부채총계", "총부채"], [], []),
    ("equity", "자본총계", "BS", "ifrs-full_Equity", ["자본총계", "총자본"], [], []),
    ("retained", "이익잉여금", "BS", "ifrs-full_RetainedEarnings", ["이익잉여금", "이익잉여금(결손금)", "결손금", "미처분이익잉여금", "미처리결손금", "미처분결손금", "이월결손금"], [], ["결손금", "미처리결손금", "미처분결손금", "이월결손금"]),
    ("revenue", "매출액", "IS", "ifrs-full_Revenue", ["매출액", "영업수익", "수익(매출액)", "매출수익"], [], []),
    ("cogs", "매출원가", "IS", "ifrs-full_CostOfSales", ["매출원가", "매출액의원가", "제품매출원가", "상품매출원가"], [], []),
    ("gross", "매출총이익", "IS", "ifrs-full_GrossProfit", ["매출총이익", "매출총이익(손실)", "매출총손실"], [], []),
    ("op_income", "영업이익", "IS", "dart_OperatingIncomeLoss", ["영업이익", "영업이익(손실)", "영업손실", "영업손익"], ["계속영업", "중단영업"], ["영업손실"]),
    ("net_income", "당기순이익", "IS", "ifrs-full_ProfitLoss", ["당기순이익", "당기순이익(손실)", "당기순손실", "분기순이익", "반기순이익", "연결당기순이익", "연결당기순이익(손실)"], ["계속영업", "중단영업"], ["당기순손실", "분기순손실", "반기순손실"]),
    ("depr", "감가상각비", "CF", None, ["감가상각비", "감가상각비용"], [], []),
    ("rou", "사용권자산상각비", "CF", None, ["사용권자산상각비", "사용권자산상각비용", "사용권자산상각", "사용권자산감가상각비", "사용권자산감가상각비용", "사용권자산감가상각"], [], []),
    ("amort", "무형자산상각비", "CF", None, ["무형자산상각비", "무형자산상각비용", "무형자산상각"], [], []),
]
NAMES = ["assets", "liabilities", "equity", "retained", "revenue", "cogs", "gross", "op_income", "net_income", "depr", "rou", "amort"]

# Words that tell statements, scopes and depreciation rows.
BS_WORDS = ["자산총계", "부채총계", "자본총계", "유동자산", "비유동자산"]
IS_WORDS = ["매출액", "영업이익", "당기순이익", "매출총이익", "영업수익", "연결당기순이익"]
TOTALS = ["자산총계", "부채총계", "자본총계", "매출액", "영업수익", "매출총이익", "영업이익", "당기순이익"]
STATEMENT_TITLES = ["재무상태표", "손익계산서", "포괄손익계산서", "현금흐름표"]
SCOPE_TITLES = ["재무상태표", "손익계산서", "포괄손익계산서", "자본변동표", "현금흐름표", "재무제표주석"]
STATEMENT_ROOTS = ["연결재무상태표", "재무상태표", "별도재무상태표", "연결손익계산서", "손익계산서", "별도손익계산서", "연결포괄손익계산서", "포괄손익계산서", "별도포괄손익계산서", "연결자본변동표", "자본변동표", "별도자본변동표", "연결현금흐름표", "현금흐름표", "별도현금흐름표"]
NOTES_ROOTS = ["연결재무제표주석", "별도재무제표주석", "재무제표주석", "연결주석", "별도주석", "주석"]
EXCLUDED_HEADERS = ["누계액", "누계", "기초잔액", "기말잔액", "취득원가", "이연법인세"]
PARTIAL_TITLES = ["유형자산", "투자부동산", "사용권자산", "리스자산", "판매비", "판관비", "관리비", "기능별"]
EXACT_DEPR = ["감가상각비", "감가상각비용"]
EXACT_ROU = ["사용권자산상각비", "사용권자산상각비용", "사용권자산상각", "사용권자산감가상각비", "사용권자산감가상각비용", "사용권자산감가상각"]
EXACT_AMORT = ["무형자산상각비", "무형자산상각비용", "무형자산상각"]
CF_MARKERS = ["영업활동현금흐름", "영업활동으로인한현금흐름"]
SECTIONS = [("재무상태표", "BS"), ("손익계산서", "IS"), ("포괄손익계산서", "IS"), ("자본변동표", "EQ"), ("현금흐름표", "CF"), ("주석", "NOTES")]

# White space, numbers, and what goes from labels, step by step.
WS_SET = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}"
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
LABEL_STEPS = (
    r"<주석?[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*[0-9,\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]+>",
    r"\(주석?[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*[0-9,\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]+\)",
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]+",
    r"^[\x{2160}-\x{216B}]+\.?",
    r"^[IVXivx]+\.",
    r"^[0-9]+\.",
    r"^[가-힣]\.",
    r"^\([0-9]+\)",
    r"^\.+|\.+$",
)
ROW_PREFIX = r"^(?:[\(\[]?[0-9①-⑳]{1,3}[\)\]]?[\.\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*|\([\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*[가나다라마바사아자차카타파하][\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*\)[\.\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*|[가나다라마바사아자차카타파하][\.\)][\.\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*)"

# Units, and how captions state them.
UNITS = {"원": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}
STRICT = r"(?i)(?:단위|금액[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*단위)[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*[:：]?[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*[\(\[]?[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*(천[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*원|백[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*만[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*원|억[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*원|원|KRW)[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*[\)\]]?"
LOOSE = r"단위.{0,12}?(천[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*원|백[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*만[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*원|억[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}]*원)"
