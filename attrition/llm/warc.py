"""Operator 10: WARC records in ZIP packages, read by range without extraction.

Writing: each task writes packages, ZIP files whose members are stored, not
compressed: ``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.cdxj`` (one line a record with its offset and length). Of pages
with equal payloads the one with the largest id becomes a ``response``; the
others become ``revisit`` records that keep the HTTP header and refer to it.
Only ids and digests are grouped for that; the pages are joined back by id, so
a payload that very many pages share stays spread over the tasks.

Reading: the end-of-central-directory record is searched in the file's tail, its
ZIP64 form is followed where there is one, the central directory gives every
member's place (sizes and offsets from ZIP64 extra fields where needed), and the
local header gives where the stored bytes begin. The index member then lists
byte ranges of records inside the archive member; those are absolute positions
in the package, read in blocks and unpacked one record at a time. Index and
records are two maps with a spread of the (small) ranges between them.

Packages are named by attempt; the manifest names only those of finished tasks.

Defined results: null html is an empty payload; pages with payloads below
``min_bytes`` are responses even if equal. Rows of one id and one payload are
all responses if theirs is the group's largest id. A null id is below all
others; a group of null ids only has responses. A null URL is written as the
record's own URN. An empty table gives no packages and an empty result. Other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import by_bytes, map_arrow, materialize, open_fs, shared_folder, table

# Fixed values of the formats.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

PACKAGE_BYTES = 1 << 30
READ_BLOCK = 8 << 20
SPREAD_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
DATE = "2020-01-01T00:00:00Z"


# -- records -----------------------------------------------------------------


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    name = value[len("<urn:page:") : -1]
    return None if name == "null" else int(name)


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else urn(page_id)[1:-1]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(block: bytes) -> tuple[str, dict[str, str], int]:
    """(first line, header fields in lower case, bytes up to the body)."""
    end = block.index(b"\r\n\r\n")
    first, *rest = block[:end].decode("utf-8").split("\r\n")
    pairs = (line.split(":", 1) for line in rest)
    return first, {k.strip().lower(): v.strip() for k, v in pairs}, end + 4


def parse_record(data: bytes) -> Record:
    version, headers, at = _fields(data)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = data[at : at + int(headers["content-length"])]
    _, http, body = _fields(block)
    return Record(headers["warc-type"], headers, http, block[body:])


def index_key(url: str) -> str:
    """The URL with its host reversed, as index lines are sorted."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        host = None
    if not host:
        return url
    rest = parts.path + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){rest or '/'}".lower()


class PackageWriter:
    """One package: records are appended, the index follows on ``close``."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri = uri
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(self._info(ARCHIVE), "w", force_zip64=True)
        self.size = 0
        self.lines: list[str] = []

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0))

    def add(self, record: bytes, url: str, digest: str, kind: str, date: str = DATE) -> None:
        packed = gzip.compress(record, compresslevel=1, mtime=0)
        self.member.write(packed)
        mime = "warc/revisit" if kind == "revisit" else "text/html"
        fields = {"url": url, "mime": mime, "status": "200", "digest": f"sha1:{digest}", "offset": self.size, "length": len(packed), "filename": ARCHIVE}
        stamp = "".join(c for c in date if c.isdigit())
        self.lines.append(f"{quote(index_key(url), safe=',)/?=&:%~')} {stamp} {json.dumps(fields)}")
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.lines.sort()
        with self.zip.open(self._info(INDEX), "w", force_zip64=True) as out:
            for line in self.lines:
                out.write(line.encode() + b"\n")
        profile = {"profile": "data-package", "resources": [{"name": n.rsplit("/", 1)[1], "path": n} for n in (ARCHIVE, INDEX)]}
        self.zip.writestr(self._info("datapackage.json"), json.dumps(profile))
        self.zip.close()
        self.sink.close()


# -- reading -----------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class PackageReader:
    """Members of a ZIP package by range reads; nothing is unpacked to disk."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.length = self.file.size()
        self.members = {m.name: m for m in self._directory()}

    def read(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def _directory(self) -> list[Member]:
        reach = min(self.length, 22 + 0xFFFF)
        start = self.length - reach
        tail = self.read(start, reach)
        at = len(tail)
        while True:
            at = tail.rfind(EOCD, 0, at)
            if at < 0:
                raise ValueError("no end of central directory")
            if at + 22 <= len(tail):
                count, size, offset, comment = struct.unpack_from("<HIIH", tail, at + 10)
                if at + 22 + comment == len(tail):
                    break
        end = start + at
        where = end - 20
        found = self.read(where, 20) if where >= 0 else b""
        if found[:4] == LOCATOR64:
            (at64,) = struct.unpack_from("<Q", found, 8)
            record = self.read(at64, 56)
            if record[:4] != EOCD64:
                raise ValueError("broken ZIP64 end of central directory")
            count, size, offset = struct.unpack_from("<QQQ", record, 32)
        elif 0xFFFF == count or 0xFFFFFFFF in (size, offset):
            raise ValueError("ZIP64 directory without a locator")
        data = self.read(offset, size)
        out, p = [], 0
        for _ in range(count):
            if data[p : p + 4] != CENTRAL:
                raise ValueError("broken central directory")
            (method,) = struct.unpack_from("<H", data, p + 10)
            packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", data, p + 20)
            (header,) = struct.unpack_from("<I", data, p + 42)
            name = data[p + 46 : p + 46 + n].decode("utf-8")
            packed, plain, header = self._wide(data[p + 46 + n : p + 46 + n + extra], plain, packed, header)
            out.append(Member(name, method, packed, header))
            p += 46 + n + extra + comment
        return out

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int, int]:
        """Values from the ZIP64 extra field, which holds those that do not fit, in this order."""
        p = 0
        while p + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, p)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                plain, packed, header = (next(values) if v == 0xFFFFFFFF else v for v in (plain, packed, header))
            p += 4 + n
        return packed, plain, header

    def data_start(self, name: str) -> int:
        """Position in the file of a stored member's first byte."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is not stored")
        local = self.read(m.header, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        n, extra = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + n + extra

    def ranges(self) -> Iterator[tuple[int, int]]:
        """(absolute position, length) of every indexed record."""
        for name, m in self.members.items():
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                starts: dict[str, int] = {}
                begin = self.data_start(name)
                rest, at = b"", 0
                while at < m.size:
                    block = self.read(begin + at, min(READ_BLOCK, m.size - at))
                    at += len(block)
                    *lines, rest = (rest + block).split(b"\n")
                    for line in lines:
                        f = json.loads(line.split(b" ", 2)[2])
                        if f["filename"] not in starts:
                            starts[f["filename"]] = self.data_start(f["filename"])
                        yield starts[f["filename"]] + int(f["offset"]), int(f["length"])

    def close(self) -> None:
        self.file.close()


# -- Spark -------------------------------------------------------------------


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the pages (``page_id, url, html``) below ``folder``; returns the manifest
    (``package, records``)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    small = F.octet_length(html) < min_bytes
    ids = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha"), small.alias("small"))
    first = ids.where("not small").groupBy("sha").agg(F.max("page_id").alias("first"))
    revisits = ids.where("not small").join(first, "sha").where("first IS NOT NULL AND (page_id IS NULL OR page_id < first)").distinct()
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "first")
    both = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha"))
    joined = rows.join(revisits, both, "left").select("page_id", "url", "html", "sha", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for b in by_bytes(batches, "html", BATCH_BYTES):
            for page_id, url, html, sha, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is not None and writer.size >= package_bytes:
                    writer.close()
                    done.append(writer)
                    writer = None
                if writer is None:
                    writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                payload = html.encode()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                kind = "response" if first is None else "revisit"
                record = format_record(page_id, url, payload, digest, first, kind == "revisit")
                writer.add(record, url or urn(page_id)[1:-1], digest, kind)
        if writer is not None:
            writer.close()
            done.append(writer)
        yield pa.RecordBatch.from_arrays([pa.array([w.uri for w in done], pa.string()), pa.array([len(w.lines) for w in done], pa.int64())], names=["package", "records"])

    return materialize(map_arrow(joined, run, "package string, records long"), "packages")


def record_ranges(packages: DataFrame) -> DataFrame:
    """(package, at, length) of every record, from the packages' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                reader = PackageReader(uri)
                at, n = np.array(list(reader.ranges()), np.int64).reshape(-1, 2).T
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(at), pa.string()), pa.array(at), pa.array(n)], names=["package", "at", "length"])

    return map_arrow(packages.select("package"), run, "package string, at long, length long")


def read_records(ranges: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)
    of the records in ``ranges``; neighbouring ranges are read in one block.

    The digest of a response is taken from the payload as read, and must equal
    the record's own; a revisit's size and digest are those it declares."""
    block = F.floor(F.col("at") / SPREAD_BYTES)
    # a fixed number of tasks: the ranges are tiny rows, what they stand for is not
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ranges.repartition(parts, "package", block).sortWithinPartitions("package", "at")

    def parse(data: bytes) -> tuple:
        record = parse_record(zlib.decompress(data, 31))
        declared = record.headers["warc-payload-digest"].split(":", 1)[1]
        page = page_of(record.headers["warc-record-id"])
        url = record.headers["warc-target-uri"]
        if record.kind == "revisit":
            return page, url, int(record.http["content-length"]), declared, "revisit", page_of(record.headers["warc-refers-to"]), None
        if digest32(record.payload) != declared:
            raise ValueError(f"payload of {record.headers['warc-record-id']} does not match its digest")
        return page, url, len(record.payload), declared, record.kind, None, record.payload

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            i = 0
            while i < len(rows):
                package, at, n = rows[i]
                j, end = i + 1, at + n
                while j < len(rows) and rows[j][0] == package and rows[j][1] == end and end - at < READ_BLOCK:
                    end += rows[j][2]
                    j += 1
                if package != uri:
                    if reader is not None:
                        reader.close()
                    uri, reader = package, PackageReader(package)
                data = reader.read(at, end - at)
                out = [parse(data[a - at : a - at + k]) for _, a, k in rows[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                i = j
        if reader is not None:
            reader.close()

    return map_arrow(spread, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    read = read_records(record_ranges(packages))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc_packages": op10_warc_packages}

ORACLE_SQL = {
    "op10_warc_packages": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INTEGER) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INTEGER) + 1, 1)
    FOR v IN [CAST('0x' || substr(h, CAST(5 * j + 1 AS INTEGER), 5) AS BIGINT) FOR j IN range(0, 8)]], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
"""
}
