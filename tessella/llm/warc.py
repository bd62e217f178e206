"""WARC archives: a writer that commits whole files and a splittable reader.

The writer gives each record a gzip member of its own. Every task writes files of its own under names that
no other attempt uses and returns them; the list that the successful tasks return is the manifest, so that
what a lost executor left behind is never read.

The reader deals byte ranges to tasks. A task looks for gzip magic within its range, checks a candidate by
its gzip header and by decoding the first bytes, which must start a WARC record, and owns each record that
starts inside, reading on past its range's end as far as the last one goes. A stored member that holds a
whole compressed WARC record of its own cannot be told from a record when a range starts inside it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import fresh_dir, small_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ID = "urn:x-page:"

BLOCK = 1 << 20
FILE_SCHEMA = "path string, bytes long, records long"
RECORD_SCHEMA = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _line(value: str) -> str:
    """A header value: line ends cannot stand in one."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that names the response and has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return _record(headers, http if revisit else http + payload)


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` (binary) of pages, and ``refers_to``: null for responses.

    Among equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response (each row, if its
    rows repeat); the others revisit it, rows without page_id among them. Where no row of a group has a page_id,
    and below ``min_bytes``, all are responses. Only ids and digests meet by digest, never the payloads.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    own = own.withColumn("_digest", F.sha1("html"))
    slim = own.filter(F.octet_length("html") >= min_bytes).select("page_id", "_digest")
    first = slim.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies"))
    first = first.filter((F.col("_copies") > 1) & F.col("_first").isNotNull()).drop("_copies")
    again = slim.join(first, "_digest").filter(~F.col("page_id").eqNullSafe(F.col("_first")))
    again = again.groupBy("page_id", "_digest").agg(F.min("_first").alias("refers_to"))
    again = again.select(F.col("page_id").alias("_id"), F.col("_digest").alias("_d"), "refers_to")
    marked = own.join(again, own.page_id.eqNullSafe(F.col("_id")) & (own["_digest"] == F.col("_d")), "left")
    return marked.select("page_id", "url", "html", "refers_to")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> list[tuple[str, int, int]]:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the manifest: path, bytes, records.

    A null html is an empty payload, a null url gives no target URI, other columns are left out. One file for
    each partition, and one row of the manifest for each file; partitions without rows write none.
    """

    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        name = f"{top}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                    info = _member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level)
                    size += out.write(info) or len(info)
                data = _member(page_record(page_id, url, html, refers, refers is not None), level)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "bytes": [size], "records": [records]})

    files = mark_revisits(pages, min_bytes).mapInArrow(write, FILE_SCHEMA).collect()
    return [(r.path, r.bytes, r.records) for r in files]


class _Bytes:
    """Random access to a file through one cached block."""

    def __init__(self, path: str):
        store, name = _place(path)
        self.file, self.at, self.block = store.open_input_file(name), 0, b""
        self.size = self.file.size()

    def get(self, pos: int, n: int) -> bytes:
        """Up to n bytes at pos, fewer at the end."""
        n = min(n, self.size - pos)
        if n <= 0:
            return b""
        if not (self.at <= pos and pos + n <= self.at + len(self.block)):
            self.file.seek(pos)
            self.at, self.block = pos, self.file.read(max(n, BLOCK))
        return self.block[pos - self.at : pos - self.at + n]

    def ahead(self, pos: int) -> bytes:
        """What the cached block has from pos on, or the next block."""
        end = self.at + len(self.block)
        return self.get(pos, end - pos if self.at <= pos < end else BLOCK)


def _decoded(data: _Bytes, pos: int) -> tuple[bytes, int] | None:
    """The gzip member at pos and the position behind it, if it is one that starts a WARC record."""
    if data.get(pos + 3, 1)[:1] > b"\x1f":  # reserved flags
        return None
    unpack, out, at = zlib.decompressobj(31), bytearray(), pos
    while not unpack.eof:
        piece = data.ahead(at)
        if not piece:
            if out.startswith(VERSION[:5]):
                raise ValueError(f"record at {pos} is cut short")
            return None
        step = piece[:4096] if not out else piece
        try:
            out += unpack.decompress(step)
        except zlib.error:
            if out.startswith(VERSION[:5]):
                raise
            return None
        if len(out) >= 5 and not out.startswith(VERSION[:5]):
            return None
        at += len(step)
    return (bytes(out), at - len(unpack.unused_data)) if out.startswith(VERSION[:5]) else None


def members(data: _Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offsets and contents of the members that start in [start, end)."""
    pos = start
    while pos < end:
        window = data.ahead(pos)
        if len(window) < len(MAGIC):
            window = data.get(pos, BLOCK)
        hit = window.find(MAGIC)
        if hit < 0:
            if pos + len(window) >= data.size:
                return
            pos += max(1, len(window) - len(MAGIC) + 1)
        elif pos + hit >= end:
            return
        elif got := _decoded(data, pos + hit):
            yield pos + hit, got[0]
            pos = got[1]
        else:
            pos += hit + 1


def records(content: bytes) -> Iterator[dict]:
    """The records of a decoded member, their headers by lower-case name, and ``block``."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        body, size = stop + 4, int(out["content-length"])
        out["block"] = content[body : body + size]
        at = body + size + 4
        yield out


def _row(path: str, offset: int, rec: dict, keep_payload: bool) -> tuple:
    kind, block = rec["warc-type"], rec["block"]
    payload, size = None, None
    if rec.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            payload = None
            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        else:
            size = len(payload)
    told = rec.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and told and digest(payload) != told:
        raise ValueError(f"{path}: the payload at {offset} does not match its digest")
    bare = lambda x: x.strip("<>") if x else None
    return path, offset, kind, bare(rec.get("warc-record-id")), bare(rec.get("warc-refers-to")), rec.get("warc-target-uri"), told, size, payload if keep_payload else None


def read_warc(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    """The records of gzip-compressed archives given as (path, bytes); no files give no rows.

    Each response's payload is checked against its digest; a damaged record raises an error.
    """
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for offset, content in members(_Bytes(path), start, end):
                    for rec in records(content):
                        rows.append(_row(path, offset, rec, payload))
                        held += len(content) if payload else 200
                        if held > 8 << 20:
                            yield pack()
                            rows, held = [], 0
        if rows:
            yield pack()

    listed = spark.createDataFrame(files, "path string, bytes long")
    ranges = listed.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    n = sum(-(-size // split_bytes) for _, size in files)
    return ranges.repartition(max(1, min(n, 100_000))).mapInArrow(scan, RECORD_SCHEMA)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, read back from the archives."""
    folder = fresh_dir(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = read_warc(spark, [(path, size) for path, size, _ in manifest], payload=False)
    number = lambda c: F.nullif(F.substr(c, F.lit(len(ID) + 1)), F.lit("")).cast("long")
    return back.filter(F.col("record_type") != "warcinfo").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
       + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
