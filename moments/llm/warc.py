"""WARC records inside ZIP packages, written and read by range.

A package is a ZIP64 file with three stored members: ``archive/data.warc.gz`` (one gzip member per record),
``indexes/index.cdxj`` (offset and length of each record in it) and ``datapackage.json``. The reader looks at the end of
the file for the central directory, finds where the members begin, reads the indexes, and fetches records by their ranges;
nothing is unpacked to disk. It takes packages of other makers, too. Only packages named in the manifest table count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.decontam import _small
from moments.llm.util import Scratch

LEAST = 1000
PACKAGE_BYTES = 1 << 30
ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- ZIP -----------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members into a stream that can't seek; sizes follow each member, ZIP64 throughout."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()), len(extra)) + name.encode() + extra)

    def write(self, data: bytes) -> None:
        self.members[-1][2] = zlib.crc32(data, self.members[-1][2])
        self.members[-1][3] += len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        size, n, end = self.at - start, len(self.members), self.at
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), 0xFFFFFFFF, 0))
        self.out.close()


def _range(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


def zip_members(source, length: int) -> dict[str, tuple[int, int, int]]:
    """name -> (where the data begins, stored size, method), from the central directory; plain and ZIP64."""
    tail_at = max(0, length - 65_557)
    tail = _range(source, tail_at, length - tail_at)
    if (k := tail.rfind(b"PK\x05\x06")) < 0:
        raise ValueError("no end of a central directory")
    n, size, at = struct.unpack_from("<HII", tail, k + 10)
    if k >= 20 and tail[k - 20 : k - 16] == b"PK\x06\x07":
        far = struct.unpack_from("<Q", tail, k - 12)[0]
        end = _range(source, far, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        n, size, at = struct.unpack_from("<QQQ", end, 32)
    directory, p, found = _range(source, at, size), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        stored, full, n_name, n_extra, n_note = struct.unpack_from("<II3H", directory, p + 20)
        head, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # only the fields that don't fit above are there, in this order
                wide, r = extra[q + 4 : q + 4 + width], 0
                if full == 0xFFFFFFFF:
                    full, r = struct.unpack_from("<Q", wide, r)[0], r + 8
                if stored == 0xFFFFFFFF:
                    stored, r = struct.unpack_from("<Q", wide, r)[0], r + 8
                if head == 0xFFFFFFFF:
                    head = struct.unpack_from("<Q", wide, r)[0]
            q += 4 + width
        local = _range(source, head, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        found[name] = (head + 30 + sum(struct.unpack_from("<HH", local, 26)), stored, method)
        p += 46 + n_name + n_extra + n_note
    return found


# ---- records -------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (small letters) and payload of a record."""
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = data[at + 4 : at + 4 + int(head["content-length"])]
    if "application/http" in head.get("content-type", ""):
        body = body[body.index(b"\r\n\r\n") + 4 :]
    return head, body


MANIFEST = "file string, records long, bytes long"


def _writer(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(base)
        system.create_dir(root, recursive=True)
        z, name, index, made = None, "", [], 0

        def close() -> pa.RecordBatch:
            z.end()
            for member, data in ((INDEX, "".join(index)), (PACKAGE, json.dumps({"profile": "data-package", "resources": [ARCHIVE, INDEX]}))):
                z.begin(member)
                z.write(data.encode())
                z.end()
            z.close()
            return pa.RecordBatch.from_pylist([{"file": f"{base}/{name}", "records": len(index), "bytes": z.at}])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                if z is None:
                    name = f"pages-{TaskContext.get().partitionId():06d}-{made:04d}-{uuid.uuid4().hex[:8]}.zip"
                    z, index, made = ZipWriter(system.open_output_stream(f"{root}/{name}")), [], made + 1
                    z.begin(ARCHIVE)
                squeeze = zlib.compressobj(1, wbits=31)
                data = squeeze.compress(record(page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(), refers_to.as_py())) + squeeze.flush()
                index.append(json.dumps({"offset": z.members[0][3], "length": len(data)}) + "\n")
                z.write(data)
                if z.at > PACKAGE_BYTES:
                    yield close()
                    z = None
        if z is not None:
            yield close()

    return run


def write_packages(spark: SparkSession, pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Writes the packages and returns their manifest. Of pages with equal payloads of at least ``least`` bytes the largest id is a response and the others revisit it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    large = F.octet_length("payload") >= least
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "original")
    groups = scratch.write(groups, "groups")
    revisit = large & (~F.col("page_id").eqNullSafe(F.col("original")))
    linked = rows.join(_small(groups), "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("original")).alias("refers_to"))
    return scratch.write(linked.mapInArrow(_writer(scratch.path("packages")), MANIFEST), "manifest")


def index_lines(data: bytes) -> list[dict]:
    """Entries of a CDXJ index: a key, a time stamp and an object a line, or the object alone. Headers (``!``) and blank lines count for nothing."""
    out = []
    for line in data.decode().splitlines():
        if line.strip() and not line.startswith("!"):
            out.append(json.loads(line if line.startswith("{") else line.split(" ", 2)[2]))
    return out


def package_ranges(source, length: int) -> list[tuple[int, int]]:
    """Where each indexed record of a package begins, and its stored length.

    Archives are the members under ``archive/``, indexes those under ``indexes/`` with cdx in their names; an entry names its
    archive unless there is only one. Archives have to be stored; indexes may be stored, and packed with gzip.
    """
    members = zip_members(source, length)
    archives = {n.rpartition("/")[2]: m for n, m in members.items() if n.startswith("archive/") and not n.endswith("/")}
    indexes = {n: m for n, m in members.items() if n.startswith("indexes/") and "cdx" in n.rpartition("/")[2]}
    if not archives or not indexes:
        raise ValueError("a package needs an archive and an index")
    if any(m[2] for m in (*archives.values(), *indexes.values())):
        raise ValueError("only stored members can be read by range")
    out = []
    for name, (at, size, _) in sorted(indexes.items()):
        data = _range(source, at, size)
        for x in index_lines(gzip.decompress(data) if name.endswith(".gz") else data):
            file = str(x.get("filename", "")).rpartition("/")[2]
            if file not in archives and (file or len(archives) > 1):
                raise ValueError(f"the index names {file or 'no archive'}")
            begin, _, _ = archives[file] if file else next(iter(archives.values()))
            out.append((begin + int(x["offset"]), int(x["length"])))
    return out


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for file in batch.column(0).to_pylist():
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as source:
                ranges = package_ranges(source, source.size())
            for k in range(0, len(ranges), 50_000):
                some = ranges[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array([a for a, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], ["file", "at", "length"])


def _sound(digest: str | None, payload: bytes) -> bool:
    """Does the payload fit its SHA-1, in hexadecimal or base 32? Other digests aren't checked."""
    kind, _, value = (digest or "").partition(":")
    found = hashlib.sha1(payload).digest()
    return kind.lower() != "sha1" or value.lower() == found.hex() or value.upper() == base64.b32encode(found).decode()


RECORD = "record_id string, type string, url string, digest string, refers_to string, payload binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    file, source = None, None
    for batch in batches:
        rows, out, k = batch.to_pylist(), [], 0
        while k < len(rows):
            e, first = k + 1, rows[k]
            while e < len(rows) and rows[e]["file"] == first["file"] and rows[e]["at"] == rows[e - 1]["at"] + rows[e - 1]["length"] and rows[e]["at"] - first["at"] < 4 << 20:
                e += 1
            if first["file"] != file:
                if source is not None:
                    source.close()
                system, path = fs.FileSystem.from_uri(first["file"])
                file, source = first["file"], system.open_input_file(path)
            data = _range(source, first["at"], rows[e - 1]["at"] + rows[e - 1]["length"] - first["at"])
            for r in rows[k:e]:
                one = data[r["at"] - first["at"] : r["at"] - first["at"] + r["length"]]
                head, payload = parse(zlib.decompress(one, wbits=31) if one[:2] == b"\x1f\x8b" else one)
                full = head["warc-type"] != "revisit"
                if full and not _sound(head.get("warc-payload-digest"), payload):
                    raise ValueError(f"payload of {head.get('warc-record-id')} isn't what it was")
                out.append((head.get("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to"), payload if full else None))
            k = e
        names = ["record_id", "type", "url", "digest", "refers_to", "payload"]
        types = [pa.string()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)
    if source is not None:
        source.close()


def read_records(packages: DataFrame) -> DataFrame:
    """record_id, type, url, digest, refers_to, payload of all indexed records of packages (file), ours or others; a revisit has no payload."""
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = packages.select("file").mapInArrow(_indexer, "file string, at long, length long")
    return ranges.repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at").mapInArrow(_reader, RECORD)


def read_packages(manifest: DataFrame) -> DataFrame:
    """The pages of our own packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html; a revisit's size and html are null."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_records(manifest).select(
        page("record_id").alias("page_id"), "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.regexp_extract("digest", "^sha1:(.*)$", 1).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), F.decode("payload", "UTF-8").alias("html"),
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each page, read back from its package.

    Reads ``page_id, url, html``; other columns are ignored. Null html is an empty payload; a null url is left out of the
    record; a null id is smaller than any, and rows that repeat the largest id are all responses; no pages, no packages.
    """
    scratch = Scratch(spark, "warc")
    read = scratch.write(read_packages(write_packages(spark, pages, scratch)).drop("html", "url"), "read")
    sizes = read.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("of"))
    out = read.join(sizes, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "of").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
m as (select d, max(page_id) o from p where n >= 1000 group by 1)
select page_id, n::bigint payload_bytes, d payload_digest, case when n >= 1000 and page_id is distinct from o then 'revisit' else 'response' end record_type,
       case when n >= 1000 and page_id is distinct from o then o end refers_to
from p left join m using (d)
"""
