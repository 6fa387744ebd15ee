"""A data source for large JSON documents: the items of one list in it, read one after the other in bounded memory.

spark.read.json needs a whole document of several lines in memory. Here a task reads a file in chunks, skips what is not asked for, and
hands on each item of the list as text; it holds one chunk and one item. Files are read in parallel, one by one task each.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time, and items of an output batch.
CHUNK, _BATCH = 1 << 20, 1000

_SPACE = re.compile(r"[ \t\r\n]*")
_BRACKET = re.compile(r'["{}\[\]]')
_IN_STRING = re.compile(r'[^"\\]*')
_NUMBER = re.compile(r"[-+.0-9eE]*")
_SCALAR = re.compile(r"[^,\]}\s]*")


class Scanner:
    """Reads values of a JSON text from a binary file, chunk by chunk."""

    def __init__(self, file: BinaryIO, chunk: int = CHUNK):
        self.file, self.chunk = file, chunk
        self.decoder = codecs.getincrementaldecoder("utf-8-sig")()
        self.text, self.at, self.ended = "", 0, False
        self.json = json.JSONDecoder()

    def _fill(self, keep: int, size: int | None = None) -> None:
        """Read on, and forget what is before `keep`."""
        data = self.file.read(size or self.chunk)
        self.ended = not data
        self.text = self.text[keep:] + self.decoder.decode(data, final=self.ended)
        self.at -= keep

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self._fill(self.at)

    def take(self, expected: str) -> None:
        found = self.peek()
        if found != expected:
            raise ValueError(f"{expected!r} expected, {found!r} found" if found else "the file ends within a value")
        self.at += 1

    def value(self) -> str:
        """The text of the next value, which is checked by reading it."""
        self.peek()
        size = self.chunk
        while True:
            try:
                if self.ended or _NUMBER.match(self.text, self.at).end() < len(self.text):  # a number may go on
                    end = self.json.raw_decode(self.text, self.at)[1]
                    found, self.at = self.text[self.at : end], end
                    return found
            except json.JSONDecodeError as error:
                if self.ended:
                    raise ValueError(f"no JSON: {error.msg}") from None
            self._fill(self.at, size)
            size *= 2  # so that a long item is not read too often

    def skip(self) -> None:
        """Pass over the next value without keeping it."""
        first, depth = self.peek(), 0
        if first not in ('"', "{", "["):
            while True:
                self.at = _SCALAR.match(self.text, self.at).end()
                if self.at < len(self.text) or self.ended:
                    return
                self._fill(self.at)
        while True:
            found = _BRACKET.search(self.text, self.at)
            if not found:
                if self.ended:
                    raise ValueError("the file ends within a value")
                self._fill(len(self.text))
                continue
            self.at = found.end()
            if found[0] == '"':
                self._string_end()
            else:
                depth += 1 if found[0] in "{[" else -1
            if depth == 0:
                return

    def _string_end(self) -> None:
        while True:
            self.at = _IN_STRING.match(self.text, self.at).end()
            if self.at + 1 >= len(self.text) and not self.ended:
                self._fill(self.at)  # an escape may lie over the end of a chunk
                continue
            if self.at >= len(self.text):
                raise ValueError("the file ends within a string")
            if self.text[self.at] == '"':
                self.at += 1
                return
            self.at += 2


def items(file: BinaryIO, path: str = "", chunk: int = CHUNK) -> Iterator[str]:
    """The text of each item of the list that a dotted path of keys leads to; the whole document is the list if the path is empty.

    Of a key that comes twice, the first counts. A path that is not there, a value that is no list, or a damaged document raises ValueError; what comes after
    the list is not read.
    """
    scan = Scanner(file, chunk)
    for key in filter(None, path.split(".")):
        scan.take("{")
        while scan.peek() == '"':
            name = json.loads(scan.value())
            scan.take(":")
            if name == key:
                break
            scan.skip()
            if scan.peek() == ",":
                scan.take(",")
        else:
            raise ValueError(f"no key {key!r}")
    scan.take("[")
    if scan.peek() == "]":
        return
    while True:
        yield scan.value()
        if scan.peek() != ",":
            scan.take("]")
            return
        scan.take(",")


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.items, self.chunk = options["path"], options.get("items", ""), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.Directory:
            listed = system.get_file_info(fs.FileSelector(root, recursive=True))
            names = sorted(x.path for x in listed if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))
        elif found.type == fs.FileType.File:
            names = [root]
        else:
            raise FileNotFoundError(self.path)
        return [_File(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        with system.open_input_stream(partition.value) as file:  # .gz and .bz2 are inflated as they are read
            held, size, place = [], 0, 0

            def batch() -> pa.RecordBatch:
                n = len(held)
                return pa.RecordBatch.from_arrays([pa.array([partition.value] * n, pa.string()), pa.array(range(place - n, place), pa.int64()), pa.array(held, pa.string())], names=["file", "place", "item"])

            for text in items(file, self.items, self.chunk):
                held.append(text)
                size, place = size + len(text), place + 1
                if len(held) == _BATCH or size > CHUNK:
                    yield batch()
                    held, size = [], 0
            if held:
                yield batch()


class JsonItems(DataSource):
    """spark.read.format("json_items").option("items", "rows").load(path): (file, place, item)."""

    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return "file string, place long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_items(spark: SparkSession, path: str, at: str = "rows", schema: str | None = None) -> DataFrame:
    """(file, place, item) for each item of the list at a dotted path in a JSON file, or each file of a folder; with a schema, its columns instead of item.

    Paths are local or of a file system that pyarrow opens.
    """
    spark.dataSource.register(JsonItems)
    rows = spark.read.format("json_items").option("items", at).load(path)
    return rows if schema is None else rows.select("file", "place", F.from_json("item", schema, {"mode": "FAILFAST"}).alias("_item")).select("file", "place", "_item.*")
