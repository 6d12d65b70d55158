"""Token ids in binary files, coded word-aligned (Simple-8b).

A 64-bit word holds a selector in its upper four bits and ``count`` ids of ``bits`` bits each below: as many as fit of
those that come next. Selector 15 is an escape: the word after it is one value as it is, of any size up to 64 bits. Ids
are coded in blocks of BLOCK, each beginning at a word of its own, and a file states where each block begins, so that
any range of ids is decoded from its own blocks, all words of a selector at a time.

A file (little-endian): MAGIC, the words, then its tables - the first word of each block and the number of all words,
the begin of each document and the number of all ids (uint64), doc_ids (int64), which of these are null (a byte each) -
and the footer: block size, numbers of ids, words, blocks and documents, CRC-32 of the tables, of the words, MAGIC.

Documents are sorted by range of doc_id, encoded where they arrive, and written as files that begin and end with a
document. Each attempt of a task writes files of its own names; the table of files, which Spark commits, says which
count. So lost executors leave files that nobody reads, never missing or double ones.

Cases
- null or empty text: the end id alone. Very long texts: whole, in one file.
- null doc_id: before all others. Ties and repeated rows: in the order of rows, each with ids of its own.
- a doc_id of very many rows spans ranges and files.
- empty table: no files, no rows. Extra columns are ignored.
- a damaged file fails the read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, tokens

MAGIC = b"S8BIDS01"
BLOCK = 1024
END_ID = 0
#: Ids after which a file ends with the document at hand.
FILE_IDS = 16 << 20
#: Documents of one range at most, about; smaller tables have a range for each shuffle partition.
RANGE = 1_000_000
#: Ids that are coded or decoded at once.
AT_ONCE = 1 << 20

#: Ids in a word, for selectors 0 to 13; each has 60 // count bits. Fixed values of the code.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
ESCAPE = 15
_LIMITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDTH16 = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    if values.size and values.max() >= 1 << 16:
        return np.searchsorted(_LIMITS, values, "right").astype(np.uint8)
    return _WIDTH16[values]


def _choices(width: np.ndarray) -> np.ndarray:
    """Of each place (columns; a row is a block), the selector of a word that begins there. Behind a block all is zero."""
    widest = {1: width}

    def over(n: int) -> np.ndarray:
        """Largest width among the n values from each place: two overlapping windows of about half of n."""
        if n not in widest:
            half = n - n // 2
            w, shift = over(half), n // 2
            out = w.copy()
            np.maximum(w[:, :-shift], w[:, shift:], out=out[:, :-shift])
            widest[n] = out
        return widest[n]

    choice = np.full(width.shape, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        choice[over(int(COUNTS[s])) <= BITS[s]] = s
    return choice


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, the number of words of each block) of values below 2**64."""
    n_blocks = -(-len(values) // block)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grid = np.zeros((n_blocks, block + int(COUNTS[0])), np.uint64)
    used = np.full(n_blocks, block)
    used[-1] = len(values) - block * (n_blocks - 1)
    full = len(values) // block
    grid[:full, :block] = values[: full * block].reshape(full, block)
    grid[full:, :block][:, : len(values) - full * block] = values[full * block :]
    choice = _choices(_widths(grid))
    taken = np.append(COUNTS, [1, 1])  # an escape takes one value
    block_of, place_of, at, active = [], [], np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    while len(active):  # all blocks step from word to word together
        block_of.append(active)
        place_of.append(at[active])
        at[active] += taken[choice[active, at[active]]]
        active = active[at[active] < used[active]]
    block_of, place_of = np.concatenate(block_of), np.concatenate(place_of)
    order = np.argsort(block_of, kind="stable")
    block_of, place_of = block_of[order], place_of[order]
    selector = choice[block_of, place_of]
    size = np.where(selector == ESCAPE, 2, 1)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[to] = selector.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        for i in range(int(COUNTS[s])):
            words[to[mine]] |= grid[block_of[mine], place_of[mine] + i] << np.uint64(i * int(BITS[s]))
    mine = np.flatnonzero(selector == ESCAPE)
    words[to[mine] + 1] = grid[block_of[mine], place_of[mine]]
    return words, np.bincount(block_of, weights=size, minlength=n_blocks).astype(np.int64)


def decode(words: np.ndarray, begins: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of blocks that begin at ``begins`` (and end at its last) in words; all but the last are full."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words) + 1, bool)
    escapes = np.flatnonzero(selector == ESCAPE)
    # A raw word may look like an escape, so in a stretch of them every second is one, from the first on, unless raw.
    if len(escapes):
        run = np.flatnonzero(np.diff(escapes, prepend=-2) > 1)
        in_run = np.arange(len(escapes)) - np.repeat(run, np.diff(run, append=len(escapes)))
        raw[escapes[in_run % 2 == 0] + 1] = True
    raw = raw[:-1]
    count = np.append(COUNTS, [0, 1])[selector]
    count[raw] = 0
    before = np.cumsum(count) - count
    n_blocks = len(begins) - 1
    first = before[begins[:-1]]
    block_of = np.repeat(np.arange(n_blocks), np.diff(begins))
    place = block_of * block + before - first[block_of]  # the last word of a block may run over its end
    left = np.minimum((block_of + 1) * block, n) - place
    out = np.empty(n, np.uint64)
    for s in range(len(COUNTS)):
        size, mask = int(COUNTS[s]), np.uint64((1 << int(BITS[s])) - 1)
        for over in (False, True):
            mine = np.flatnonzero((selector == s) & ~raw & ((left < size) == over))
            if len(mine):
                to = place[mine][:, None] + np.arange(size)
                values = (words[mine][:, None] >> (np.arange(size, dtype=np.uint64) * np.uint64(BITS[s]))) & mask
                inside = np.arange(size) < left[mine][:, None] if over else ...
                out[to[inside]] = values[inside]
    mine = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[place[mine]] = words[mine + 1]
    return out


class FileWriter:
    """One file: documents are added, their ids coded as blocks fill up."""

    def __init__(self, path: str, block: int = BLOCK) -> None:
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.block, self.out = path, block, where.open_output_stream(name)
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_words = self.crc = 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_ids += len(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= AT_ONCE:
            self._write(self.n_waiting // self.block * self.block)

    def _write(self, n: int) -> None:
        values = np.concatenate([np.zeros(0, np.uint16), *self.waiting])
        step = max(1, AT_ONCE // self.block) * self.block
        for at in range(0, n, step):
            words, sizes = encode(values[at : min(at + step, n)], self.block)
            raw = words.astype("<u8").tobytes()
            self.out.write(raw)
            self.crc = zlib.crc32(raw, self.crc)
            self.n_words += len(words)
            self.sizes.append(sizes)
        self.waiting, self.n_waiting = [values[n:]], len(values) - n

    def close(self) -> tuple[str, int, int, int]:
        """(path, ids, documents, bytes)."""
        self._write(self.n_waiting)
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes])
        tables = b"".join(
            [
                np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
                np.array([*self.starts, self.n_ids], "<u8").tobytes(),
                np.array([0 if d is None else d for d in self.docs], "<i8").tobytes(),
                bytes(d is None for d in self.docs),
            ]
        )
        numbers = [self.block, self.n_ids, self.n_words, len(sizes), len(self.docs), zlib.crc32(tables), self.crc]
        self.out.write(tables + np.array(numbers, "<u8").tobytes() + MAGIC)
        size = self.out.tell()
        self.out.close()
        return self.path, self.n_ids, len(self.docs), size


class FileReader:
    """Tables of one file; its ids are decoded by range."""

    FOOTER = 7 * 8 + len(MAGIC)

    def __init__(self, path: str) -> None:
        where, name = fs.FileSystem.from_uri(path)
        self.path, self.file = path, where.open_input_file(name)
        size = self.file.size()
        end = self.file.read_at(self.FOOTER, size - self.FOOTER) if size >= self.FOOTER else b""
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no file of token ids, or was cut off")
        self.block, self.n_ids, self.n_words, n_blocks, n_docs, tables_crc, self.words_crc = np.frombuffer(end[:56], "<u8").astype(int).tolist()
        at = len(MAGIC) + 8 * self.n_words
        tables = self.file.read_at(size - self.FOOTER - at, at)
        if zlib.crc32(tables) != tables_crc or len(tables) != 8 * (n_blocks + 1) + 8 * (n_docs + 1) + 9 * n_docs:
            raise ValueError(f"{path}: its tables are damaged")
        numbers = np.frombuffer(tables[: 8 * (n_blocks + n_docs + 2)], "<u8").astype(np.int64)
        self.begins, self.starts = numbers[: n_blocks + 1], numbers[n_blocks + 1 :]
        self.docs = np.frombuffer(tables, "<i8", n_docs, 8 * (n_blocks + n_docs + 2))
        self.nulls = np.frombuffer(tables, np.uint8, n_docs, len(tables) - n_docs).astype(bool)

    def verify(self) -> None:
        """Read all words against their checksum."""
        crc = 0
        for at in range(0, self.n_words, AT_ONCE):
            crc = zlib.crc32(self.file.read_at(8 * min(AT_ONCE, self.n_words - at), len(MAGIC) + 8 * at), crc)
        if crc != self.words_crc:
            raise ValueError(f"{self.path}: its words are damaged")

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from ``start`` (of this file), from the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint64)
        first, last = start // self.block, -(-(start + n) // self.block)
        begin = int(self.begins[first])
        raw = self.file.read_at(8 * (int(self.begins[last]) - begin), len(MAGIC) + 8 * begin)
        there = min(last * self.block, self.n_ids) - first * self.block
        values = decode(np.frombuffer(raw, "<u8"), self.begins[first : last + 1] - begin, there, self.block)
        return values[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number in the file, start, ids) of each document, decoded about AT_ONCE ids at a time."""
        self.verify()
        i, n_docs = 0, len(self.docs)
        while i < n_docs:
            to = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + AT_ONCE, "right")) - 1)
            base = int(self.starts[i])
            values = self.ids(base, int(self.starts[to]) - base)
            for k in range(i, to):
                yield k, int(self.starts[k]), values[self.starts[k] - base : self.starts[k + 1] - base]
            i = to


FILES = "part int, file int, path string, n_ids bigint, n_docs bigint, n_bytes bigint"


def _write(root: str, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, n = None, None, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, (part, n, *writer.close()), strict=True))], schema)

        names = [c.split()[0] for c in FILES.split(", ")]
        schema = pa.schema([pa.field(c, t) for c, t in zip(names, [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3], strict=True)])
        for b in batches:
            for doc_id, text, p in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("part").to_pylist(), strict=True):
                if writer and (p != part or writer.n_ids >= file_ids):
                    yield closed()
                    writer, n = None, n + 1 if p == part else 0
                if not writer:
                    part, writer = p, FileWriter(f"{root}/ids-{p:06}-{n:04}-{uuid.uuid4().hex}.s8b")
                writer.add(doc_id, tokens.packed(tokens.ids(text.as_py()), end))
        if writer:
            yield closed()

    return run


@shared.sized
def write(documents: DataFrame, root: str, end: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write the token ids of documents (doc_id, text), ``end`` after each, in ascending order of doc_id: files in
    ``root``, and in ``root/files`` the table of those that count, with the ids and documents before each."""
    spark = documents.sparkSession
    docs = shared.pick(documents, doc_id="bigint", text="string").withColumn("rid", F.monotonically_increasing_id())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE))
    # Texts are sorted, not ids: sampling the ranges then reads a column and tokenises nothing.
    order = docs.repartitionByRange(parts, "doc_id", "rid").sortWithinPartitions("doc_id", "rid").select("doc_id", "text", F.spark_partition_id().alias("part"))
    files = shared.settle(shared.in_batches(order, _write(root, end, file_ids), FILES), "id-files")
    # A range has few files; sums over ranges run over one row each, and are joined back.
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.sum("n_docs").alias("docs"))
    everything, within = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = ranges.select("part", total("ids", everything).alias("_ids"), total("docs", everything).alias("_docs"))
    files = files.join(ranges, "part").select(
        "part", "file", "path", "n_ids", "n_docs", "n_bytes",
        (F.col("_ids") + total("n_ids", within)).alias("ids_before"), (F.col("_docs") + total("n_docs", within)).alias("docs_before"),
    )
    files.write.parquet(f"{root}/files")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("ids_before").to_pylist(), strict=True):
                file = FileReader(path)
                rows: list[tuple] = []
                held = 0
                for k, start, ids in file.documents():
                    raw = ids.astype("<u4").tobytes()
                    rows.append((None if file.nulls[k] else int(file.docs[k]), before + start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    held += len(raw) if with_ids else 0
                    if len(rows) >= 10_000 or held >= shared.BATCH_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.binary()], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read(spark: SparkSession, root: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) ids, four bytes each, of every document, decoded from the files."""
    files = spark.read.schema(f"{FILES}, ids_before bigint, docs_before bigint").parquet(f"{root}/files")
    tasks = max(1, min(files.count(), 100_000))
    found = shared.in_batches(files.select("path", "ids_before").repartition(tasks), _read(with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return found if with_ids else found.drop("ids")


def op11_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared.new_path(spark, "token-files")
    write(shared.table(spark, sf_dir, "documents"), root)
    return read(spark, root, with_ids=False)
