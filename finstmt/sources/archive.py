"""Filing archives (ZIP files named after their rcept_no) as a Spark data source, to read and to write.

    spark.dataSource.register(FilingArchives)
    spark.read.format("filing_archives").load(folder)        # rcept_no, member, size, rank, content
    archives.write.format("filing_archives").save(folder)    # rcept_no, member, content

Small archives share a partition up to ``splitBytes``; an archive that is larger is read by a partition for each of its
members, found in its directory. Ranks (1: the largest file, ties by name) come from directories alone, and members are
read one at a time and handed on in batches of about 1 MB, so a task holds that or one member, never an archive. ``maxBytes`` leaves out larger archives, broken ones
have no rows. Files are opened where the tasks run, so any file system that pyarrow knows by its URI will do.

What the driver holds hardly follows the number of archives: it lists one folder after another and keeps the names of a
partition compressed, and of what a task wrote it gets the names of lists, which it reads piece by piece. Written with
the option ``folders``, archives lie in that many folders, by a checksum of their names; all that is written to one path must have
the same.
"""

from __future__ import annotations

import contextlib
import heapq
import itertools
import json
import os
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MEMBER = "rcept_no string, member string, size bigint, rank int, content binary"
MOST_BYTES = 10 * 1024 * 1024
SPLIT_BYTES = 8 * 1024 * 1024
#: Bytes of members that go out in one batch; one that is larger goes alone.
TOGETHER = 1024 * 1024
#: Threads that rename archives when they are committed, and how many are handed to one together.
MOVES, MOVES_TOGETHER = 16, 64
#: Archives of one list that a task leaves for the driver, and bytes of it that are read at once.
LISTED, BLOCK = 10_000, 16 * 1024
#: What reading a file that is no archive, or not all of one, raises; errors of the file system are not among them.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid)
_ARROW = pa.schema([("rcept_no", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("rank", pa.int32()), ("content", pa.binary())])


def _ranked(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: (-i.file_size, i.filename))


@dataclass
class _Share(InputPartition):
    """Whole archives, or the one member of one archive that has this rank. packed: their paths below root, compressed."""

    root: str
    packed: bytes
    rank: int | None = None

    @classmethod
    def of(cls, root: str, paths: list[str], rank: int | None = None) -> _Share:
        return cls(root, zlib.compress(os.fsencode("\0".join(sorted(paths)))), rank)

    @property
    def paths(self) -> list[str]:
        return [f"{self.root}/{p}" for p in os.fsdecode(zlib.decompress(self.packed)).split("\0") if p]


def _listed(where: fs.FileSystem, root: str, below: str = "") -> Iterator[tuple[str, int]]:
    """(path below root, size) of the archives there, one folder after another. Where folders are of this machine (or
    mounted), not even one's listing is held whole."""
    folders = []
    if isinstance(where, fs.LocalFileSystem):
        with os.scandir(f"{root}/{below}") as entries:
            for e in entries:
                if e.is_dir():
                    folders.append(f"{below}{e.name}/")
                elif e.name.endswith(".zip") and e.is_file():
                    yield f"{below}{e.name}", e.stat().st_size
    else:
        for f in where.get_file_info(fs.FileSelector(f"{root}/{below}".rstrip("/"))):
            if f.type == fs.FileType.Directory:
                folders.append(f"{below}{f.base_name}/")
            elif f.is_file and f.extension == "zip":
                yield f"{below}{f.base_name}", f.size
    for f in sorted(folders):
        yield from _listed(where, root, f)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most, self.split = int(options.get("maxbytes", MOST_BYTES)), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[_Share]:
        where, root = fs.FileSystem.from_uri(self.path)
        shares: list[_Share] = []
        together: list[str] = []
        held = 0
        for path, size in _listed(where, root):
            if size > self.most:
                continue
            if size > self.split:
                shares += [_Share.of(root, [path], r) for r in range(1, 1 + self._members(where, f"{root}/{path}"))]
                continue
            if together and held + size > self.split:
                shares.append(_Share.of(root, together))
                together, held = [], 0
            together.append(path)
            held += size
        return [*shares, *([_Share.of(root, together)] if together else [])] or [_Share.of(root, [])]

    def _members(self, where: fs.FileSystem, path: str) -> int:
        try:
            with where.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return len(_ranked(z))
        except BROKEN:
            return 0

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        held, rows = 0, []
        for r in self._rows(partition):
            rows.append(r)
            held += len(r["content"])
            if held >= TOGETHER:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                held, rows = 0, []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _rows(self, partition: _Share) -> Iterator[dict]:
        where, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            key = path.rpartition("/")[2].removesuffix(".zip")
            try:
                with where.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    for rank, i in enumerate(_ranked(z), 1):
                        if partition.rank in (None, rank):
                            yield {"rcept_no": key, "member": i.filename, "size": i.file_size, "rank": rank, "content": z.read(i)}
            except BROKEN:
                continue


@dataclass
class _Written(WriterCommitMessage):
    """Lists of the archives that a task wrote; each has at most LISTED of them, in the order of their names."""

    lists: list[str]


def _lines(where: fs.FileSystem, path: str) -> Iterator[list[str]]:
    """Lines of a list: an archive, its name until it is committed. The file isn't kept open, so many can be read side by side."""
    at, rest = 0, b""
    while True:
        with where.open_input_file(path) as f:
            f.seek(at)
            block = f.read(BLOCK)
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        yield from map(json.loads, whole)
        if not block:
            return


class _Writer(DataSourceWriter):
    """Each task writes archives under names of its attempt; the driver gives those of successful tasks their own names."""

    def __init__(self, options: dict) -> None:
        self.path, self.folders = options["path"], int(options.get("folders", 0))

    def _folder(self, root: str, key: str) -> str:
        return f"{root}/{zlib.crc32(f'{key}'.encode()) % self.folders:05d}" if self.folders else root

    def write(self, rows: Iterator) -> _Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        attempt, n, made = uuid.uuid4().hex, 0, {root}
        lists: list[str] = []
        files: list[tuple[str, str]] = []

        def listed() -> None:
            lists.append(f"{root}/.{attempt}-{len(lists)}.list")
            with where.open_output_stream(lists[-1]) as out:
                for f in sorted(files):
                    out.write(json.dumps(f).encode() + b"\n")
            files.clear()

        for key, members in itertools.groupby(rows, lambda r: r.rcept_no):
            folder = self._folder(root, key)
            if folder not in made:
                where.create_dir(folder)
                made.add(folder)
            files.append((f"{folder}/{key}.zip", f"{folder}/.{key}.{attempt}-{n}"))
            n += 1
            with where.open_output_stream(files[-1][1]) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for r in members:
                    z.writestr(zipfile.ZipInfo(r.member), bytes(r.content), zipfile.ZIP_DEFLATED)
            if len(files) >= LISTED:
                listed()
        if files:
            listed()
        return _Written(lists)

    def commit(self, messages: list[_Written | None]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)
        lists = [x for m in messages if m for x in m.lists]
        names = (to for to, _ in heapq.merge(*(_lines(where, x) for x in lists)))
        if any(a == b for a, b in itertools.pairwise(names)):  # and Spark aborts
            raise ValueError("rows of one archive must come to one task, in a row: repartition by rcept_no and sort within partitions")

        def moved(files: tuple[list[str], ...]) -> None:
            for to, name in files:
                where.move(name, to)

        with ThreadPoolExecutor(MOVES) as pool:
            for x in lists:
                for some in itertools.batched(_lines(where, x), MOVES * MOVES_TOGETHER):
                    list(pool.map(moved, itertools.batched(some, MOVES_TOGETHER)))
        for x in lists:
            where.delete_file(x)

    def abort(self, messages: list[_Written | None]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)

        def gone(path: str) -> None:
            with contextlib.suppress(FileNotFoundError):
                where.delete_file(path)

        for x in (x for m in messages if m for x in m.lists):
            with contextlib.suppress(FileNotFoundError):  # of a commit that broke off at its end
                for _, name in _lines(where, x):
                    gone(name)
            gone(x)


class FilingArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_archives"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
