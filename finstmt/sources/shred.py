"""Statement documents (loosely marked-up XML or HTML, also inside ZIP archives) to ordered nodes.

The one place where Python reads marks: malformed input must give what can be read of it. Documents are
spread over tasks by Spark; nothing of a document is kept beyond its own rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive
from .settled import bounded

NODE = "doc_id string, pos int, kind string, title_text string, rows array<array<string>>, prev_texts array<string>, parent_prev_texts array<string>, head_tr_texts array<string>"
CELLS = ("td", "th", "tu", "te")
#: Elements of a table that a start tag ends where their own end tag is missing.
ENDED_BY = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag with plain attributes, or characters; what is in RAW elements, or tags within ESCAPABLE ones, is left to the parser.
PLAIN = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z-]+=(?:"[^"<>&]+"|[A-Za-z0-9]+))*)>|([^<]+)""")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)=(?:"([^"]+)"|([A-Za-z0-9]+))""")
RAW = frozenset("script style textarea xmp iframe noembed noframes noscript plaintext".split())
ESCAPABLE = ("title",)


class _Element:
    __slots__ = ("tag", "children", "parent", "texts", "attrs")

    def __init__(self, tag: str, parent: _Element | None, attrs: list | None = None):
        self.tag, self.parent, self.children, self.texts, self.attrs = tag, parent, [], [], attrs

    def text(self) -> str:
        """All text below, each piece trimmed."""
        if len(self.texts) == 1 and isinstance(self.texts[0], str):
            return self.texts[0].strip()
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e.strip())
            else:
                todo.extend(reversed(e.texts))
        return "".join(out)

    def below(self, *tags: str) -> Iterator[_Element]:
        todo = list(reversed(self.children))
        while todo:
            e = todo.pop()
            if e.tag in tags:
                yield e
            if e.children:
                todo.extend(reversed(e.children))


class _Tree(HTMLParser):
    """Elements in document order; a stray end tag is ignored, a missing one ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and self.at.tag == "p":  # a paragraph ends where a table begins
            self.at = self.at.parent
        self._end_open(tag)
        e = _Element(tag, self.at, attrs if tag in CELLS else None)
        self.at.children.append(e)
        self.at.texts.append(e)
        if tag not in VOID:
            self.at = e

    def _end_open(self, tag: str) -> None:
        """End the cells or the row, of the table at hand, that this start tag ends."""
        e, ends = self.at, ENDED_BY.get(tag, ())
        while e is not None and e.tag != "table" and ends:
            if e.tag in ends:
                self.at = e.parent
            e = e.parent

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.texts.append(data)

    def plain(self, text: str) -> bool:
        """The same for a text of plain tags and characters alone, which needs no parser; False as soon as anything else
        is met, and then this tree is of no use."""
        at = 0
        for m in PLAIN.finditer(text):
            if m.start() != at:
                return False
            at = m.end()
            end, tag, attrs, data = m.groups()
            if data is not None:
                self.handle_data(unescape(data) if "&" in data else data)
                continue
            tag = tag.lower()
            if tag in RAW or self.at.tag in ESCAPABLE and not end or end and attrs:
                return False
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(k.lower(), quoted or bare) for k, quoted, bare in ATTRIBUTE.findall(attrs)] if attrs else [])
        return at == len(text)


def _previous(e: _Element, most: int) -> list[str]:
    """Texts of the elements before e under the same parent, nearest first."""
    if e is None or e.parent is None:
        return []
    sisters = e.parent.children
    at = next(i for i, x in enumerate(sisters) if x is e)
    return [x.text() for x in reversed(sisters[max(0, at - most) : at])]


def _cells(table: _Element) -> list[list[str]]:
    return [[c.text() for c in tr.below(*CELLS)] for tr in table.below("tr")]


def _read(text: str) -> _Element:
    tree = _Tree()
    if tree.plain(text):
        return tree.root
    tree = _Tree()
    try:
        tree.feed(text)
        tree.close()
    except (AssertionError, ValueError):  # what was read so far stays
        pass
    return tree.root


def _span(cell: _Element, name: str) -> int:
    """A cell's rowspan or colspan: 1 where it is absent or no number, 1,000 at most, as browsers have it."""
    value = next((v for k, v in cell.attrs or () if k == name), None) or ""
    return max(1, min(int(value), 1000)) if value.strip().isascii() and value.strip().isdigit() else 1


def _own(e: _Element, tags: tuple[str, ...]) -> Iterator[_Element]:
    """Elements below e, but not those of tables within it."""
    todo = list(reversed(e.children))
    while todo:
        x = todo.pop()
        if x.tag in tags:
            yield x
        if x.tag != "table":
            todo.extend(reversed(x.children))


def grid(table: _Element) -> list[list[str]]:
    """A table's rows with every cell in each place that it spans; rows end where their last cell does."""
    rows: list[list[str]] = []
    below: dict[int, tuple[int, str]] = {}  # column: rows that the cell above still takes, its text
    for tr in _own(table, ("tr",)):
        row: dict[int, str] = {}
        left, below = below, {}

        def put(at: int, n: int, text: str) -> None:
            row[at] = text
            if n > 1:
                below[at] = (n - 1, text)

        for at, (n, text) in left.items():
            put(at, n, text)
        at = 0
        for cell in _own(tr, CELLS):
            while at in row:
                at += 1
            text, deep = cell.text(), _span(cell, "rowspan")
            for _ in range(_span(cell, "colspan")):
                if at not in row:
                    put(at, deep, text)
                at += 1
        rows.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
    return rows


def shred(text: str) -> list[dict]:
    """Titles and tables of a document in order."""
    root = _read(text)
    out: list[dict] = []
    for e in root.below("title", "table"):
        node = {"pos": len(out), "kind": e.tag, "title_text": None, "rows": None, "prev_texts": None, "parent_prev_texts": None, "head_tr_texts": None}
        if e.tag == "title":
            node["title_text"] = e.text()
        else:
            cells = _cells(e)
            node |= {"rows": [r for r in cells if any(r)], "prev_texts": _previous(e, 10), "parent_prev_texts": _previous(e.parent, 3), "head_tr_texts": [c for r in cells[:5] for c in r]}
        out.append(node)
    return out


def decoded(content: bytes) -> str:
    for encoding in ("utf-8", "euc-kr"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


_TYPES = {"pos": pa.int32(), "kind": pa.string(), "title_text": pa.string(), "rows": pa.list_(pa.list_(pa.string())), "prev_texts": pa.list_(pa.string()), "parent_prev_texts": pa.list_(pa.string()), "head_tr_texts": pa.list_(pa.string())}


#: Bytes of documents whose rows go out together.
TOGETHER = 1 << 20


def in_rows(batches: Iterator[pa.RecordBatch], read: Callable[[bytes], list[dict]], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """doc_id and the fields of read(content) for each row (doc_id, content); those of small documents in one batch, so
    that neither a batch for each document nor all of a large batch's rows at once are made."""
    held, rows, docs = 0, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in types.items())], ["doc_id", *types])

    for b in batches:
        for doc, content in zip(b.column("doc_id"), b.column("content"), strict=True):
            whole = content.as_py() or b""
            found = read(whole)
            rows += found
            docs += [doc.as_py()] * len(found)
            held += len(whole)
            if held >= TOGETHER:
                yield out()
                held, rows, docs = 0, [], []
    if rows:
        yield out()


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_rows(batches, lambda content: shred(decoded(content)), _TYPES)


def nodes(documents: DataFrame) -> DataFrame:
    """doc_node rows of documents (doc_id string, content binary)."""
    return bounded(documents.select("doc_id", F.col("content").cast("binary").alias("content"))).mapInArrow(_shred, NODE)


def archives(spark: SparkSession, path: str, most_bytes: int = archive.MOST_BYTES, split_bytes: int = archive.SPLIT_BYTES) -> DataFrame:
    """Members of landed ZIP files (rcept_no from the file's name), largest first (``rank``); archives above
    the limit are left out, broken ones have no rows."""
    spark.dataSource.register(archive.FilingArchives)
    return spark.read.format("filing_archives").option("maxBytes", most_bytes).option("splitBytes", split_bytes).load(path)


def write_archives(members: DataFrame, path: str, folders: int = 0) -> None:
    """ZIP files of members (rcept_no, member, content), in so many folders (0: none) of path."""
    members.sparkSession.dataSource.register(archive.FilingArchives)
    together = members.select("rcept_no", "member", F.col("content").cast("binary").alias("content")).repartition("rcept_no").sortWithinPartitions("rcept_no", "member")
    together.write.format("filing_archives").option("folders", folders).mode("append").save(path)
