"""Plain documents without a parser, and batches of bounded bytes."""

import pyarrow as pa
import pytest

from finstmt.sources import archive, settled, shred


def tree(e):
    return e.tag, e.attrs or [], [x if isinstance(x, str) else tree(x) for x in e.texts]


def parsed(markup):
    t = shred._Tree()
    t.feed(markup)
    t.close()
    return t.root


@pytest.mark.parametrize("markup", [
    "<BODY><TITLE>1. 가&amp;나 &lt;</TITLE><DIV><P>x</P><TABLE><TR><TD>1<TD>2</TR><TR><TH rowspan=2 COLSPAN=\"3\">a &nbsp b</TH></TABLE></BODY>", "a<br>b<p>c<table><tr><td>d</table>e</p></x></body>", "", "nur &am", "<td><td></tr></table>",
])
def test_plain_documents_need_no_parser(markup, monkeypatch):
    want = tree(parsed(markup))
    monkeypatch.setattr(shred._Tree, "feed", None)
    assert tree(shred._read(markup)) == want


@pytest.mark.parametrize("markup", ["<TITLE>a<b>c</b></TITLE>d", "<script>a<b</script>c", "a < b <p>", "<p class='x y'>a</p>", "<td nowrap>1", "<!-- <p> --><p>b", "<p/>a<br/>b", "a<p", "</p x=1>y", "<td a=\"&lt;\">z", "<a:b>c</a:b>"])
def test_other_documents_are_parsed_as_ever(markup):
    assert tree(shred._read(markup)) == tree(parsed(markup)) and not shred._Tree().plain(markup)


def test_documents_share_batches_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(shred, "TOGETHER", 100)
    docs = pa.RecordBatch.from_pydict({"doc_id": [f"d{i}" for i in range(20)], "content": pa.array([b"<TITLE>abc</TITLE>"] * 20, pa.binary())})
    out = list(shred._shred(iter([docs])))
    assert [b.num_rows for b in out] == [6, 6, 6, 2] and [x for b in out for x in b.column("doc_id").to_pylist()] == [f"d{i}" for i in range(20)]


def test_members_share_batches(spark, tmp_path):
    shred.write_archives(spark.createDataFrame([(f"s{i}", "m", b"x" * 50) for i in range(40)], "rcept_no string, member string, content binary"), f"file://{tmp_path}")
    reader = archive._Reader({"path": f"file://{tmp_path}"})
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [40]


def test_arrow_batches_have_bounds(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        shred.nodes(spark.createDataFrame([("d", b"")], "doc_id string, content binary"))
        assert [int(spark.conf.get(k)) for k in keys] == [settled.BATCH_ROWS, settled.BATCH_BYTES]
        spark.conf.set(keys[0], "7")
        settled.bounded(spark.range(1))
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
