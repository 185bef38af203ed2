"""A Spark data source of line JSON in folders by day: pruned by pushed filters, and a stream that replays and then follows.

    register(spark)
    spark.read.format("line_json").schema("id long, day string, v string").option("path", root).load().where("day = '2024-01-02'")
    spark.readStream.format("line_json").schema(...).option("path", root).option("lines", "1000").load()

Lines lie in root/day=<day>/<name>.jsonl (or another `suffix`) and are only ever appended. In a batch read, filters on `day` choose folders before a file is
opened, and the files of a folder are read in pieces of `piece` bytes, each cut at line ends, by one task each. In a stream an offset
has, for each file, how many bytes have been handed over: a stream that starts replays all that is there and then follows what
is appended, at most about `piece` bytes of a file and `files` files a batch, and a restart goes on from the checkpoint. A line
without its line end is still being written: it isn't read until it ends. Lines that are no JSON objects are skipped; what a line lacks
is null. Paths are local or those of any file system of pyarrow (hdfs://, s3://).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Options' defaults.
PIECE, FILES = 8 << 20, 1000


class Piece(InputPartition):
    def __init__(self, path: str, day: str, start: int, end: int):
        self.path, self.day, self.start, self.end = path, day, start, end


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _listed(root: str, suffix: str = ".jsonl") -> list[tuple[str, str, int]]:
    """(path, day, bytes) of all files, by day and name."""
    fs, top = _opened(root)
    found = fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        parts = f.path.rsplit("/", 2)
        if f.type == pafs.FileType.File and f.path.endswith(suffix) and len(parts) == 3 and parts[1].startswith("day="):
            out.append((f.path, parts[1].removeprefix("day="), f.size))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _rows(root: str, schema: StructType, piece: Piece, exact: bool) -> Iterator[tuple]:
    """The lines that begin in a piece; exact: the piece is whole lines already. A line without an end isn't read."""
    fs, _ = _opened(root)
    with fs.open_input_file(piece.path) as f:
        start = piece.start
        if start and not exact:  # what began before belongs to the piece before
            f.seek(start - 1)
            start += _until_line_end(f) - 1
        f.seek(start)
        rest = b""
        while start < piece.end:
            data = f.read(1 << 20)
            if not data:
                return
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if start >= piece.end:
                    return
                start += len(line) + 1
                if (row := _parsed(line, schema, piece.day)) is not None:
                    yield row


def _until_line_end(f: Any) -> int:
    n = 0
    while data := f.read(1 << 16):
        at = data.find(b"\n")
        if at >= 0:
            return n + at + 1
        n += len(data)
    return n + 1


def _parsed(line: bytes, schema: StructType, day: str) -> tuple | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return tuple(day if f.name == "day" else found.get(f.name) for f in schema.fields) if isinstance(found, dict) else None


class LineReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.piece, self.schema, self.days = options["path"].rstrip("/"), int(options.get("piece", PIECE)), schema, None
        self.suffix = options.get("suffix", ".jsonl")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over equality and membership of the day; the rest is Spark's."""
        for f in filters:
            chosen = {f.value} if isinstance(f, EqualTo) and f.attribute == ("day",) else set(f.value) if isinstance(f, In) and f.attribute == ("day",) else None
            if chosen is None:
                yield f
            else:
                self.days = chosen if self.days is None else self.days & chosen

    def partitions(self) -> list[Piece]:
        files = [x for x in _listed(self.root, self.suffix) if self.days is None or x[1] in self.days]
        return [Piece(path, day, lo, min(lo + self.piece, size)) for path, day, size in files for lo in range(0, size, self.piece)] or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _rows(self.root, self.schema, partition, False) if partition.path else iter(())


class LineStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.piece, self.files, self.schema = options["path"].rstrip("/"), int(options.get("piece", PIECE)), int(options.get("files", FILES)), schema
        self.suffix = options.get("suffix", ".jsonl")
        self.handed: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Up to the last line end within reach of what has been handed over."""
        fs, _ = _opened(self.root)
        offset, grown = dict(self.handed), 0
        for path, _, size in _listed(self.root, self.suffix):
            start = offset.get(path, 0)
            if size > start and grown < self.files and (end := self._line_end(fs, path, start, size)) > start:
                offset[path] = end
                grown += 1
        self.handed = offset
        return offset

    def _line_end(self, fs: pafs.FileSystem, path: str, start: int, size: int) -> int:
        """The last line end within a piece from start on, or the first after it."""
        with fs.open_input_file(path) as f:
            f.seek(start)
            data = f.read(min(self.piece, size - start))
            at = data.rfind(b"\n")
            if at >= 0:
                return start + at + 1
            n = len(data)
            while more := f.read(1 << 20):
                at = more.find(b"\n")
                if at >= 0:
                    return start + n + at + 1
                n += len(more)
        return start

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.handed = {**end, **{k: max(v, end.get(k, 0)) for k, v in self.handed.items()}}
        return [Piece(path, path.rsplit("/", 2)[1].removeprefix("day="), start.get(path, 0), size) for path, size in sorted(end.items()) if size > start.get(path, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _rows(self.root, self.schema, partition, True)


class LineJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_json"

    def schema(self) -> str:
        return "day string, value string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options, schema)

    def streamReader(self, schema: StructType) -> LineStream:
        return LineStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineJson)
