"""WARC archives: writing pages with one gzip member per record, and a sequential reader.

The reader inflates each member as its bytes arrive, frames the block by Content-Length and verifies both digests on the
way, so that a record takes no more memory than its payload, and that only where the payload is wanted. Each record has
an id of its own, to which revisits refer.
Archives lie in a folder that all executors share and are opened through pyarrow's file systems, so that folder may be
local, HDFS or an object store. Tasks write under names of their own; a manifest names the files of the attempts that
counted, so a lost executor leaves at most a file that nothing reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Record ids: that of the page, and the number of its row.
_ID = "<urn:page:{}:{}>"
_CHUNK = 1 << 18
#: A header of more bytes is none.
_HEAD = 1 << 20
_END = b"\r\n\r\n"
#: Rows and payload bytes of one batch that the reader yields.
_ROWS, _BYTES = 1024, 8 << 20

_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, number long, refers_number long"


class Record(NamedTuple):
    headers: dict[str, str]
    size: int  # of the payload
    payload: bytes | None


def digest(data: bytes) -> str:
    """SHA-1 in base32, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _sha1(sha: bytes) -> str:
    return f"sha1:{base64.b32encode(sha).decode()}"


# Writing -----------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, number: int) -> str:
    return _ID.format("" if page_id is None else page_id, number)


def record_bytes(own_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str, level: int) -> bytes:
    """One record as a gzip member; one that refers to another is a revisit, with the digest of its payload only."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": own_id,
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + deflate.flush()


def write_archives(
    pages: DataFrame, scratch: Scratch, id_col="page_id", url_col="url", html_col="html", min_bytes: int = 0, date="2024-01-01T00:00:00Z", level: int = 4
) -> DataFrame:
    """Write a record for each page; return the manifest (path, records), one row for each archive.

    Of the pages whose equal payloads have min_bytes bytes or more, the one with the largest id (of several rows with
    it, one) is a response and the others revisit it. Shorter payloads are all responses. A null html is an empty
    payload, a null url leaves out the target header, a null id is smaller than any other.
    """
    data = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    rows = scratch.numbered(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), data.alias("payload")), "row")
    rows = rows.withColumn("same", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    groups = rows.where("same is not null").groupBy("same").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
    groups = scratch.write(groups.where("n > 1").select("same", "best"), "groups")
    dealt = rows.join(groups, "same", "left").select(
        "id", "row", "url", "payload", F.expr("best is not null and best.row != row").alias("revisit"), F.col("best.id").alias("refers_to"), F.col("best.row").alias("refers_row")
    )
    root = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, count, path = None, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system, folder = fs.FileSystem.from_uri(root)
                system.create_dir(folder, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                path, out = f"{root}/{name}", system.open_output_stream(f"{folder}/{name}", compression=None)
            for row in zip(*batch.columns):
                page, number, url, payload, revisit, to, to_number = (c.as_py() for c in row)
                out.write(record_bytes(record_id(page, number), url, payload, record_id(to, to_number) if revisit else None, date, level))
            count += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return scratch.write(dealt.mapInArrow(run, "path string, records long"), "manifest")


# Reading -----------------------------------------------------------------------------------------------------------


class _Framer:
    """One record, fed with its bytes as they arrive. ValueError where its framing or a digest is wrong."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.headers, self.tail = keep_payload, b"", None, b""
        self.left, self.http, self.size, self.parts = 0, b"", 0, []
        self.block_sha, self.payload_sha, self.in_payload = hashlib.sha1(), hashlib.sha1(), False

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            head, gap, data = (self.head + data).partition(_END)
            if not gap:
                self.head = head
                if len(head) > _HEAD or not head.startswith(b"WARC/"[: len(head)]):
                    raise ValueError("no WARC record")
                return
            self._parse(head)
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_sha.update(block)
        if not self.in_payload:
            self.http, gap, block = (self.http + block).partition(_END)
            self.in_payload = bool(gap)
        self.payload_sha.update(block)
        self.size += len(block)
        if self.keep:
            self.parts.append(block)
        self.tail += rest
        if len(self.tail) > len(_END):
            raise ValueError(f"bytes behind the end of {self.headers.get('warc-record-id')}")

    def _parse(self, head: bytes) -> None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        self.headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        self.left = int(self.headers["content-length"])

    def finish(self) -> Record:
        if self.headers is None or self.left or self.tail != _END:
            raise ValueError("Content-Length doesn't fit the record")
        checks = [("warc-block-digest", self.block_sha)]
        checks += [("warc-payload-digest", self.payload_sha)] if self.headers["warc-type"] == "response" else []
        for name, sha in checks:
            if self.headers.get(name, want := _sha1(sha.digest())) != want:
                raise ValueError(f"{name} of {self.headers.get('warc-record-id')} differs")
        return Record(self.headers, self.size, b"".join(self.parts) if self.keep else None)


def records(stream, keep_payload: bool = True) -> Iterator[Record]:
    """The records of a stream of gzip members, one each; ValueError for a damaged or cut one."""
    data = stream.read(_CHUNK)
    while data:
        inflate, framer = zlib.decompressobj(31), _Framer(keep_payload)
        while not inflate.eof:
            data = data or stream.read(_CHUNK)
            if not data:
                raise ValueError("the last record is cut off")
            try:
                framer.feed(inflate.decompress(data, _CHUNK))
            except zlib.error as damage:
                raise ValueError(f"no gzip member: {damage}") from damage
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        yield framer.finish()
        data = data or stream.read(_CHUNK)


def _page(urn: str | None) -> tuple[int | None, int | None]:
    """The page and the row of a record id."""
    page, _, number = (urn or "").removeprefix("<urn:page:").removesuffix(">").partition(":")
    return int(page) if page else None, int(number) if number else None


def _row(record: Record) -> tuple:
    h = record.headers
    revisit = h["warc-type"] == "revisit"
    page, number = _page(h["warc-record-id"])
    refers_to, refers_number = _page(h.get("warc-refers-to"))
    size, payload = (None, None) if revisit else (record.size, record.payload)
    return page, h.get("warc-target-uri"), h["warc-type"], refers_to, size, h["warc-payload-digest"].removeprefix("sha1:"), payload, number, refers_number


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in manifest.path: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload, number, refers_number (of the row of the record, and of that which it refers to).

    payload and payload_bytes are null for a revisit. An archive whose framing or digests are wrong fails the job.
    """
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column(0)):
            system, file = fs.FileSystem.from_uri(path)
            rows, size = [], 0
            with system.open_input_stream(file, compression=None) as stream:
                for record in records(stream, keep_payload):
                    rows.append(_row(record))
                    size += len(rows[-1][6] or b"")
                    if len(rows) >= _ROWS or size >= _BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives, "path").mapInArrow(run, _RECORD)


def archive_round_trip(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", min_bytes: int = 0) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    One row per row of pages, in any order. payload_bytes of a revisit is that of the response it refers to. url is
    percent-encoded where a header can't hold it. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, scratch, id_col, url_col, html_col, min_bytes), keep_payload=False).drop("payload")
    found = scratch.write(found, "records")
    revisits, responses = found.where("record_type = 'revisit'"), found.where("record_type = 'response'")
    sizes = responses.select(F.col("number").alias("to"), F.col("payload_bytes").alias("size"))
    sizes = scratch.write(sizes.join(revisits.select(F.col("refers_number").alias("to")).distinct(), "to", "left_semi"), "sizes")
    filled = revisits.join(sizes, F.col("refers_number") == F.col("to"), "left").withColumn("payload_bytes", F.col("size"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return responses.select(columns).unionByName(filled.select(columns))


def query(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
           + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER same THEN NULL ELSE max(page_id) OVER same END AS refers_to
FROM p WINDOW same AS (PARTITION BY html)
"""
