"""Data sources of two binary table layouts, for ``spark.read.format("string_table")`` and ``("key_values")``.

    register(spark)
    spark.read.format("string_table").load("/folder/*.bin")

The option ``path`` is a file, a folder, or a pattern in the last part; anything but a local path is opened by
``pyarrow.fs``. Files are dealt to partitions by size, ``bytes_per_task`` each; the driver lists them and reads the header of one.

A string table has a header row and rows of any length, whose cells are offsets into one table of strings. Its schema is _path,
_row, _error and the first readable file's header names as strings; other files' columns go by name. Missing cells
are null, cells beyond the header are left out, repeated or empty header names get a number. Key-value blocks are rows (path, key,
kind, value, size, error). Files that are broken or cut short give one row that says why, or, with the option mode=FAILFAST,
fail the job.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Fixed values of the layouts: the first words of a string table, its cell mark; magic numbers and kinds of key-value blocks.
GRID_HEAD, GRID_MARK = (1, 2), 0x2C
BLOCK_MAGIC, WRAPPER_MAGIC, WRAPPER_SIZE, ENTRY, HEAD = b"\0PSF", b"SCEC", 0x800, 16, 20
KINDS = {0x0004: "special", 0x0204: "text", 0x0404: "integer"}


class Broken(ValueError):
    """Why a file can't be read."""


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder, or of those that match a pattern."""
    from pyarrow import fs

    folder, _, last = path.rpartition("/")
    wild = any(c in last for c in "*?[")
    system, inner = fs.FileSystem.from_uri(folder if wild else path) if "://" in path else (fs.LocalFileSystem(), folder or "." if wild else path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and (not wild or fnmatch.fnmatch(f.base_name, last))]
    return sorted((prefix + f.path, f.size) for f in found)


def _read(path: str) -> bytes:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(inner) as f:
        return f.read()


class _Words:
    """Little-endian numbers of a file, one after another; reading past its end breaks."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int, what: str) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise Broken(f"cut short in {what}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, what: str) -> int:
        return struct.unpack("<i", self.take(4, what))[0]

    def count(self, what: str) -> int:
        n = self.number(what)
        if n < 0 or n * 4 > len(self.raw) - self.at:
            raise Broken(f"{what} of {n} exceed the file")
        return n


def grid(raw: bytes) -> tuple[list[str], Iterator[list[str]]]:
    """The header and the rows of a string table."""
    w = _Words(raw)
    if (w.number("the head"), w.number("the head")) != GRID_HEAD or w.take(1, "the head")[0] != GRID_MARK:
        raise Broken("no string table")
    strings = w.take(w.number("the strings' size"), "the strings")
    if w.at >= len(raw):
        raise Broken("the strings exceed the file")

    def text(what: str) -> str:
        at = w.number(what)
        if not 0 <= at < len(strings):
            raise Broken(f"{what} lies outside of the strings")
        end = strings.find(b"\0", at)
        return strings[at : len(strings) if end < 0 else end].decode("utf-8", "replace")

    header = [text("a header cell") for _ in range(w.count("header cells"))]

    def rows():
        for _ in range(w.count("rows")):
            yield [text("a cell") for _ in range(w.count("cells"))]

    return header, rows()


def named(header: list[str]) -> list[str]:
    """Column names: those of the header, numbered where they are empty or taken."""
    out: list[str] = []
    for k, name in enumerate(header):
        name = name or f"column{k}"
        while name.lower() in (x.lower() for x in (*out, "_path", "_row", "_error")):
            name += f"_{k}"
        out.append(name)
    return out


def entries(raw: bytes) -> Iterator[tuple[str, str, str, int]]:
    """(key, kind, value, room) of a key-value block, which may stand in a wrapper."""
    start = WRAPPER_SIZE if raw[:4] == WRAPPER_MAGIC else 0
    if raw[start : start + 4] != BLOCK_MAGIC:
        raise Broken("no key-value block")
    if len(raw) < start + HEAD:
        raise Broken("cut short in the head")
    keys, values, n = struct.unpack_from("<iii", raw, start + 8)
    for k in range(n):
        at = start + HEAD + k * ENTRY
        if at + ENTRY > len(raw):
            raise Broken("cut short in the entries")
        key_at, kind, size, room, value_at = struct.unpack_from("<HHiiI", raw, at)
        key_at, value_at = start + keys + key_at, start + values + value_at
        end = raw.find(b"\0", key_at)
        if end < 0 or size < 0 or value_at + (4 if kind == 0x0404 else size) > len(raw):
            raise Broken(f"entry {k} exceeds the file")
        key = raw[key_at:end].decode("ascii", "replace")
        if kind not in KINDS:
            raise Broken(f"unknown kind {kind:04X}")
        if kind == 0x0404:
            value = str(struct.unpack_from("<i", raw, value_at)[0])
        else:
            value = raw[value_at : value_at + (max(size - 1, 0) if kind == 0x0204 else size)].decode("utf-8", "replace")
        yield key, KINDS[kind], value, room


class _Part(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, rows):
        self.options, self.schema, self.rows = options, schema, rows

    def partitions(self):
        most, parts, held = int(self.options.get("bytes_per_task", 64 << 20)), [[]], 0
        for path, size in _files(self.options["path"]):
            if parts[-1] and held + size > most:
                parts.append([])
                held = 0
            parts[-1].append(path)
            held += size
        return [_Part(p) for p in parts]

    def read(self, partition):
        strict = self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        for path in partition.files:
            try:
                yield from self.rows(path, _read(path), self.schema)
            except Broken as why:
                if strict:
                    raise ValueError(f"{path}: {why}") from why
                yield self.rows(path, None, self.schema, str(why))


def _grid_rows(path, raw, schema, why=None):
    names = schema.fieldNames()
    row = lambda **known: tuple(known.get(n) for n in names)
    if raw is None:
        return row(_path=path, _error=why)
    header, rows = grid(raw)
    header = named(header)
    return [row(_path=path, _row=k, **dict(zip(header, cells, strict=False))) for k, cells in enumerate(rows)]


def _entry_rows(path, raw, schema, why=None):
    if raw is None:
        return (path, None, None, None, None, why)
    return [(path, *e, None) for e in entries(raw)]


class StringTables(DataSource):
    """Rows of string tables."""

    @classmethod
    def name(cls) -> str:
        return "string_table"

    def schema(self) -> StructType:
        header = []
        for path, _ in _files(self.options["path"]):
            try:
                header = named(grid(_read(path))[0])
                break
            except Broken:
                continue
        fixed = [StructField("_path", StringType()), StructField("_row", IntegerType()), StructField("_error", StringType())]
        return StructType([*fixed, *(StructField(n, StringType()) for n in header)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema, _grid_rows)


class KeyValues(DataSource):
    """Entries of key-value blocks."""

    @classmethod
    def name(cls) -> str:
        return "key_values"

    def schema(self) -> str:
        return "path string, key string, kind string, value string, size int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema, _entry_rows)


def register(spark: SparkSession) -> None:
    for source in (StringTables, KeyValues):
        spark.dataSource.register(source)
