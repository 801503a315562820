"""Operator 10: round trips, revisits by brute force, and the ZIP directory forms."""

from __future__ import annotations

import base64
import hashlib
import zipfile

import pytest

from attrition.llm import warc
from attrition.llm.common import shared_folder
from tests.conftest import SF_SMALL


def brute(rows, min_bytes=0):
    groups = {}
    for i, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        first = max(ids) if ids else None
        response = len(data) < min_bytes or i == first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_op10_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = warc.op10_warc_packages(spark, SF_SMALL)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert plain(got) == brute([(r.page_id, r.html) for r in pages])


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_copies_nulls_repeats_long_pages_and_small_packages(spark, tmp_path, min_bytes):
    texts = ["abcdef", "abcdef", None, "", "abc", "abc", "é" * 100_000, "x\r\n\r\ny", "abcdef", "\r\n\r\n"]
    rows = [(i if i != 4 else None, texts[i % len(texts)]) for i in range(40)] + [(30, "abcdef"), (30, "abcdef"), (None, "lone"), (None, "lone")]
    urls = ["http://a.b/c?d=e f", None, "not a url\n", "http://[bad", "https://é.example/ü"]
    pages = spark.createDataFrame([(i, urls[n % 5], h, "s", 1) for n, (i, h) in enumerate(rows)], "page_id long, url string, html string, sha string, first int")
    packages = warc.write_packages(pages, f"file://{tmp_path}/w", min_bytes=min_bytes, package_bytes=300)
    assert packages.count() > 4
    records = warc.read_records(warc.record_ranges(packages))
    assert plain(records) == brute(rows, min_bytes)
    got = sorted(bytes(r.payload) for r in records.where("record_type = 'response'").collect())
    want = sorted((h or "").encode() for (i, h), b in zip(rows, [dict(brute_type(rows, min_bytes))[n] for n in range(len(rows))], strict=True) if b == "response")
    assert got == want
    empty = warc.write_packages(pages.limit(0), shared_folder(spark, "w"))
    assert warc.read_records(warc.record_ranges(empty)).count() == 0


def brute_type(rows, min_bytes):
    for n, (i, h) in enumerate(rows):
        ids = [x for x, t in rows if (t or "") == (h or "") and x is not None]
        first = max(ids) if ids else None
        yield n, "response" if len((h or "").encode()) < min_bytes or i == first else "revisit"


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06" + b"z" * 30])
@pytest.mark.parametrize("wide", [False, True])
def test_directory_forms(tmp_path, monkeypatch, wide, comment):
    if wide:  # every size, offset and count takes its ZIP64 form
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one.txt", b"first member")
        z.writestr("ü/two.txt", b"second")
        z.writestr(zipfile.ZipInfo("packed.txt"), b"p" * 100, zipfile.ZIP_DEFLATED)
        z.comment = comment
    reader = warc.PackageReader(f"file://{path}")
    assert list(reader.members) == ["one.txt", "ü/two.txt", "packed.txt"]
    for name, data in (("one.txt", b"first member"), ("ü/two.txt", b"second")):
        assert reader.read(reader.data_start(name), reader.members[name].size) == data
    with pytest.raises(ValueError, match="not stored"):
        reader.data_start("packed.txt")
    (tmp_path / "b.zip").write_bytes(b"no archive at all")
    with pytest.raises(ValueError, match="central directory"):
        warc.PackageReader(f"file://{tmp_path}/b.zip")


def test_standard_tools_read_the_packages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string")
    uri = warc.write_packages(pages, f"file://{tmp_path}/w").first().package
    with zipfile.ZipFile(uri[len("file://") :]) as z:
        assert z.testzip() is None
        assert {i.filename: i.compress_type for i in z.infolist()} == dict.fromkeys([warc.ARCHIVE, warc.INDEX, "datapackage.json"], 0)
        import gzip

        assert gzip.decompress(z.read(warc.ARCHIVE)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_op10_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    sql = con.sql(warc.ORACLE_SQL["op10_warc_packages"])
    assert sql.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(sql.fetchall(), key=repr) == plain(warc.op10_warc_packages(spark, SF_SMALL))
