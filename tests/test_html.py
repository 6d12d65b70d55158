"""Pages of unknown encoding, and grids of cells that span."""

import pytest

from finstmt.functions import catalog
from finstmt.sources import html, shred


def rows_of(markup):
    return [shred.grid(t) for t in shred._read(markup).below("table")]


@pytest.mark.parametrize(("content", "want"), [
    ("<meta charset=utf-8>가".encode("euc-kr"), "utf-8"), ('<META CHARSET="UTF-8">x'.encode(), "utf-8"), (b"<?xml encoding='EUC-KR'?>", "euc-kr"), (b"charset=ks_c_5601-1987", "euc-kr"),
    ("가나다".encode(), "utf-8"), ("가나다".encode("euc-kr"), "euc-kr"), (b"", "utf-8"), (b" " * 3000 + b"euc-kr", "utf-8"), (b"\xff\xfe\x00", "euc-kr"),
])
def test_encoding(content, want):
    assert html.encoding(content) == want


def test_spans_fill_their_places():
    assert rows_of("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>") == [[["a", "a", "b"], ["a", "a", "c"], ["d", "e", "f"]]]
    assert rows_of("<table><tr><td>a<td rowspan=3>b<td>c<tr><td colspan=2>d<tr></table>") == [[["a", "b", "c"], ["d", "b"], ["", "b"]]]  # what overlaps stays as it was
    assert rows_of("<table><tr><td colspan=x>a<td colspan=0>b<td rowspan='-1'>c<td colspan>d</table>") == [[["a", "b", "c", "d"]]]
    assert len(rows_of("<table><tr><td colspan=999999>a</table>")[0][0]) == 1000
    assert rows_of("<table><tr><td>out<table><tr><td rowspan=2>in</table><td>x</table>") == [[["outin", "x"]], [["in"]]]
    assert rows_of("<table></table>") == [[]] and rows_of("<table><tr><td>a") == [[["a"]]]


def test_tables_and_items(spark):
    page = "<p>단위: 백만원</p><table><tr><th>과목<th>주<th>금액<tr><td>1. 자산총계<td>-<td>(7)<tr><td>부채 총계<td>x<td>8<tr><td>부채총계<td>x<td>9</table>"
    more = "<table><tr><td>자본총계</table><table><tr><td>자산총계<td>1<tr><td>영업손실<td>5</table>"
    pages = spark.createDataFrame([("u", (page + more).encode()), ("k", (page + more).encode("euc-kr")), ("none", b""), ("null", None), ("large", b"<table><tr><td>a" + b" " * 5000)], "doc_id string, content binary")
    found = html.tables(pages, 4000)
    assert sorted((r.doc_id, r.table_no) for r in found.collect()) == [(d, n) for d in "ku" for n in (1, 2, 3)]
    got = {(r.doc_id, r.item): r.value for r in html.items(found, catalog.items(spark)).collect()}
    assert {k: v for k, v in got.items() if k[1] != "op_income"} == {(d, i): v for d in "ku" for i, v in (("assets", -7e6), ("liabilities", 8e6))}
    assert {k[0] for k in got if k[1] == "op_income"} == {"k", "u"}
