import hashlib
import io
import zipfile

import pytest

from moments.llm import warc
from moments.llm.util import Scratch

BIG = "é<p>" * 400
PAGES = [(1, "http://a/", BIG), (2, None, BIG), (7, "http://b\r\nX: y", BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "x" * 1000), (8, "u", "x" * 999), (9, "u", "x" * 999), (None, "u", BIG), (10, "u", "a\r\n\r\nb"), (11, "u", "z" * 300_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1, "f") for p in PAGES], "page_id long, url string, html string, n int, file string")
    got = {r.page_id: tuple(r)[1:] for r in warc.archive_round_trip(spark, pages.repartition(3)).collect()}
    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        again = html == BIG and page_id != 7
        assert got[page_id] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_packages_are_zip_and_records_come_back(spark):
    scratch = Scratch(spark, "test-warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_packages(spark, pages, scratch)
    for r in manifest.collect():
        with zipfile.ZipFile(r.file.removeprefix("file://")) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX, warc.PACKAGE}
            assert len(z.read(warc.INDEX).splitlines()) == r.records
    full = {r.page_id: r.html for r in warc.read_packages(manifest).where("record_type = 'response'").collect()}
    assert full == {p: h or "" for p, _, h in PAGES if h != BIG or p == 7}


def test_foreign_zip():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b.txt", b"hello")
        z.writestr("c", b"")
        z.comment = b"note PK"
    at, size, method = warc.zip_members(raw, len(raw.getvalue()))["a/b.txt"]
    assert raw.getvalue()[at : at + size] == b"hello" and method == 0
    with pytest.raises(ValueError):
        warc.zip_members(io.BytesIO(b"nothing"), 7)


def test_packages_of_others(spark, tmp_path):
    """Two archives, one of them not packed, CDXJ lines with keys, a packed index, base-32 digests and records that aren't responses."""
    import base64
    import gzip
    import json

    def rec(kind, rid, body, digest=None, http=True):
        body = (b"HTTP/1.1 200 OK\r\n\r\n" + body) if http else body
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}", f"Content-Length: {len(body)}"] + ([f"WARC-Payload-Digest: {digest}"] if digest else [])
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    b32 = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    packed = [gzip.compress(rec("warcinfo", "i", b"software: x\r\n", http=False)), gzip.compress(rec("response", "r", b"hello", b32))]
    plain = rec("response", "p", b"other", "md5:zz")
    with zipfile.ZipFile(tmp_path / "a.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/one.warc.gz", b"".join(packed))
        z.writestr("archive/two.warc", plain)
        lines = ["!meta", f"com,a)/ 2024 {json.dumps({'filename': 'one.warc.gz', 'offset': '0', 'length': str(len(packed[0]))})}", f"com,a)/b 2024 {json.dumps({'filename': 'one.warc.gz', 'offset': str(len(packed[0])), 'length': str(len(packed[1]))})}"]
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
        z.writestr("indexes/more.cdxj", "com,a)/c 2024 " + json.dumps({"filename": "archive/two.warc", "offset": 0, "length": len(plain)}))
    packages = spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "file string")
    got = {r.record_id: (r.type, bytes(r.payload)) for r in warc.read_records(packages).collect()}
    assert got == {"<i>": ("warcinfo", b"software: x\r\n"), "<r>": ("response", b"hello"), "<p>": ("response", b"other")}
