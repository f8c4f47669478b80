"""WARC records in ZIP-packaged archives, written and range-read.

An archive is one ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``
(one gzip member a record), ``indexes/index.cdx`` (one JSON line a record with
offset and length) and ``datapackage.json``. A reader parses the end of central
directory, the ZIP64 locator and record, and the central directory, finds where a
stored member begins, reads the index as one range and then records as ranges;
nothing is extracted.

Files are reached through ``pyarrow.fs``, so executors write to any shared store
it knows. An archive is written under an attempt's own name and listed in a
manifest (a Parquet table) when its task ends; archives of lost attempts are in no
manifest and never read.

Defined results: a null payload is empty; repeated rows are records of their own;
of equal payloads of at least ``REVISIT_BYTES`` the largest page_id is the
response (each of them, where it repeats) and the others, null ids included,
revisit it; if all ids are null, all are responses. An empty table gives no
archive and no rows. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, prepare_python

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
SALT = 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

# ---------------------------------------------------------------- ZIP reading


class RangeFile:
    """Range reads of a file in any store."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def members(source: RangeFile) -> dict[str, tuple[int, int, int]]:
    """Name -> (offset of local header, stored size, method), from the central directory."""
    tail_at = max(0, source.size - 65557)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (record_at,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
        record = source.read(record_at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end of central directory")
        count, size, at = struct.unpack("<QQQ", record[32:56])
    directory, found, p = source.read(at, size), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, plain = struct.unpack("<II", directory[p + 20 : p + 28])
        n_name, n_extra, n_note = struct.unpack("<HHH", directory[p + 28 : p + 34])
        (header,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                if plain == 0xFFFFFFFF:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF:
                    header = wide.pop(0)
            extra = extra[4 + n :]
        found[name] = (header, packed, method)
        p += 46 + n_name + n_extra + n_note
    return found


def stored_range(source: RangeFile, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    header, size, method = member
    if method != 0:
        raise ValueError("member is compressed; only stored members are range-read")
    local = source.read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return header + 30 + n_name + n_extra, size


# ------------------------------------------------------------------- writing


def _record(page_id, url, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    kind = "revisit" if refers_to is not None else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archive:
    """One archive that is being written; data.warc.gz is streamed as a stored member."""

    def __init__(self, folder: str, salt: int = 0):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        where, path = fs.FileSystem.from_uri(self.uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, url, payload, digest, refers_to) -> None:
        packed = _gzip(_record(page_id, url, payload, digest, refers_to, len(payload)))
        self.data.write(packed)
        self.lines.append(json.dumps({"id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        index = "".join(x + "\n" for x in self.lines).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        parts = [{"path": DATA, "bytes": self.at}, {"path": INDEX, "bytes": len(index)}]
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": parts}))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.lines)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the manifest (uri, n_records)."""
    spark = pages.sparkSession
    prepare_python(spark)
    scratch = Scratch(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    light = rows.select("page_id", "digest", F.octet_length("html").alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    twins = light.groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1 and first is not null")
    twins = twins.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    marked = dealt.join(twins, ["digest", "salt"], "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    )
    marked = marked.select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                archive = archive or _Archive(folder)
                archive.add(page_id.as_py(), url.as_py(), html.cast(pa.binary()).as_py(), digest.as_py(), refers_to.as_py())
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["uri", "n_records"])

    return scratch.save("manifest", marked.mapInArrow(write, "uri string, n_records long"))


# ------------------------------------------------------------------- reading

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _parse(raw: bytes) -> tuple:
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = lambda key: int(fields[key][10:-1]) if fields.get(key, "<urn:page:>") != "<urn:page:>" else None
    payload = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError("payload does not match its digest")
    else:
        payload = None
    return page("WARC-Record-ID"), json.loads(f'"{fields["WARC-Target-URI"]}"'), kind, page("WARC-Refers-To"), digest, size, payload


def read_records(uri: str) -> Iterator[tuple]:
    """Records of one archive, by its index; neighbouring records share a range read."""
    source = RangeFile(uri)
    found = members(source)
    at, size = stored_range(source, found[INDEX])
    index = [json.loads(x) for x in source.read(at, size).decode().splitlines()]
    base, _ = stored_range(source, found[DATA])
    k = 0
    while k < len(index):
        to, first = k + 1, index[k]["offset"]
        while to < len(index) and index[to]["offset"] + index[to]["length"] - first <= RANGE_BYTES:
            to += 1
        block = source.read(base + first, index[to - 1]["offset"] + index[to - 1]["length"] - first)
        for entry in index[k:to]:
            begin = entry["offset"] - first
            yield _parse(block[begin : begin + entry["length"]])
        k = to
    source.close()


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives listed in ``uri``; an archive is one unit of work."""
    prepare_python(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                for record in read_records(uri):
                    rows.append(record if payloads else (*record[:-1], None))
                    held += len(record[-1] or b"") if payloads else 0
                    if len(rows) >= 2000 or held >= RANGE_BYTES:
                        yield emit(rows)
                        rows, held = [], 0
                if rows:
                    yield emit(rows)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri").repartition(spread, "uri").mapInArrow(read, RECORDS)


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, Scratch(spark, "wacz").root)
    records = read_archives(manifest, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP1_SQL = f"""
WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND first IS NOT NULL AND (page_id IS NULL OR page_id < first) THEN first END AS refers_to FROM g)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
