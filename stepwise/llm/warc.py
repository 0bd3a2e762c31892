"""Legacy ARC archives converted to WARC, and WARC reading.

An ARC archive opens with a version block whose second line names the version;
the third line names the fields of every record header (five in version 1, ten
in version 2).  Records are found by their declared lengths alone, so payloads
may hold anything; archives may be gzip members, and a URL may hold blanks.  The
converter keeps the block, the address and, of what is not HTTP, the type and synthesises the WARC
fields ARC lacks: record ids (UUIDv5 of target, date and block digest), ISO
dates, record types and SHA-1 digests.  Of records with equal payloads (of at
least ``min_bytes``) the one with the largest key is the response; the others
become revisits without a payload.

Defined results: a null payload is empty; a null URL gets ``unknown:``; blanks
and controls in a URL are percent-encoded; a null key never beats another (with
only null keys all are responses); rows that repeat the largest key are all
responses; empty tables give no archives; archives are cut near ``limit``
bytes, a longer record stands alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm.common import slices

#: Record header fields of the two ARC versions (fixed values of the format).
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
MIME = re.compile(r"[\w.+-]+/[\w.+-]+")
ARC_DATE = "20240101000000"
ARCHIVE_BYTES = 8 << 20
KEY_HEADER = "X-Page-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PARSED = "key long, uri string, date string, mime string, ip string, head binary, payload binary, payload_bytes long, digest string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe_url(url: str | None) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "unknown:"


# ---- ARC ----

def arc_version_block(version: str, name: str) -> bytes:
    body = f"{version} 0 stepwise\n{ARC_FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain {len(body)}\n".encode() + body + b"\n"


def arc_record(version: str, name: str, offset: int, url: str | None, block: bytes) -> bytes:
    if version == "1":
        head = f"{_safe_url(url)} 0.0.0.0 {ARC_DATE} text/html {len(block)}\n"
    else:
        head = f"{_safe_url(url)} 0.0.0.0 {ARC_DATE} text/html 200 - - {offset} {name} {len(block)}\n"
    return head.encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the version block."""
    def line(at: int) -> tuple[list[str], int]:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header at byte {at} is cut off")
        return data[at:end].decode("utf-8", "replace").rstrip("\r").split(" "), end + 1

    if data[:2] == b"\x1f\x8b":  # the usual form: one or many gzip members
        data = gzip.decompress(data)
    if not data:
        return
    first, at = line(0)
    if not first[0].startswith("filedesc://"):
        raise ValueError("not an ARC archive: no filedesc record")
    body = data[at: at + int(first[-1])].decode("utf-8", "replace").split("\n")
    version = body[0].split(" ")[0]
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    names = (body[1] if len(body) > 1 and body[1].strip() else ARC_FIELDS[version]).strip().split(" ")
    at += int(first[-1])
    while True:
        while data[at: at + 1] in (b"\n", b"\r"):  # the separator
            at += 1
        if at >= len(data):
            return
        values, at = line(at)
        if len(values) < len(names):
            raise ValueError(f"ARC header of {len(values)} fields where version {version} has {len(names)}")
        spare = len(values) - len(names)  # blanks in the URL, which stands first
        fields = dict(zip(names, [" ".join(values[:spare + 1]), *values[spare + 1:]]))
        size = int(fields["Archive-length"])
        if at + size > len(data):
            raise ValueError("ARC record is shorter than its declared length")
        yield fields, data[at: at + size]
        at += size


def arc_archives(df: DataFrame, key_col: str, url_col: str, body_col: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): ARC archives of a crawl table, versions 1 and 2 in turn."""
    src = df.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"),
                    F.col(body_col).cast("string").cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.arc"]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

        for b in slices(batches, "body", limit):
            for key, url, body in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("body").to_pylist()):
                body = body or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n"
                head += f"{KEY_HEADER}: {key}\r\n\r\n" if key is not None else "\r\n"
                version, name = "12"[(part + number) % 2], f"part-{part:06d}-{number:06d}.arc"
                if not parts:
                    parts.append(arc_version_block(version, name))
                    size = len(parts[0])
                parts.append(arc_record(version, name, size, url, head.encode() + body))
                size += len(parts[-1])
                if size >= limit:
                    yield close()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield close()

    return src.mapInArrow(run, "path string, content binary")


def _http_split(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return b"", block, {}
    head = block[: cut + 4]
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head, block[cut + 4:], dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x))


def _iso(date: str) -> str:
    """ARC's 14 digits (or fewer, padded) as a WARC date."""
    d = (date + "00000101000000"[len(date):]) if date.isdigit() and len(date) < 14 else date
    if not (d.isdigit() and len(d) >= 14):
        d = ARC_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_arc(archives: DataFrame) -> DataFrame:
    """Records of ARC archives given as (path, content), as Spark's binaryFile reader gives them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows: list[tuple] = []
                for f, block in parse_arc(data.as_py() or b""):
                    head, body, http = _http_split(block)
                    key = http.get(KEY_HEADER.lower())
                    rows.append((int(key) if key else None, _safe_url(f["URL"]), _iso(f["Archive-date"]), f.get("Content-type", ""), f.get("IP-address", ""), head, body, len(body), sha1_base32(body)))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                     ["key", "uri", "date", "mime", "ip", "head", "payload", "payload_bytes", "digest"])

    return archives.select("content").mapInArrow(run, PARSED)


# ---- WARC ----

def _record_id(uri: str, date: str, key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {key} {digest}')}>"


def _warc(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def convert(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Parsed ARC records with ``response_key`` (null for a response) and what a
    revisit must cite of its response."""
    who = (records.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
           .agg(F.max(F.when(F.col("key").isNotNull(), F.struct("key", "uri", "date"))).alias("r"), F.count("*").alias("n"))
           .where("n > 1 and r is not null").select(F.col("digest").alias("_d"), F.col("payload_bytes").alias("_n"), "r"))
    joined = records.join(who, (F.col("digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_n")), "left").drop("_d", "_n")
    # what is not HTTP, a DNS answer for one, is a resource and stays whole
    other = F.col("r").isNotNull() & ~F.col("key").eqNullSafe(F.col("r.key")) & (F.octet_length("head") > 0)
    # a revisit carries no payload
    return joined.select("key", "uri", "date", "mime", "ip", "head", F.when(~other, F.col("payload")).alias("payload"), "payload_bytes", "digest",
                         F.when(other, F.col("r.key")).alias("to_key"), F.when(other, F.col("r.uri")).alias("to_uri"), F.when(other, F.col("r.date")).alias("to_date"))


def warc_archives(records: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(content): WARC archives of converted records, each opened by a warcinfo record."""
    def record(r: dict) -> bytes:
        key, uri, date, digest = r["key"], r["uri"], r["date"], r["digest"]
        body = r["payload"] if r["payload"] is not None else b""
        block = r["head"] + body
        fields = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Record-ID", _record_id(uri, date, key, digest)),
                  ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
        if r["ip"] not in ("", "-", "0.0.0.0"):  # what ARC writes where it knows none
            fields.append(("WARC-IP-Address", r["ip"]))
        if not r["head"]:
            return _warc("resource", fields + [("Content-Type", r["mime"] if MIME.fullmatch(r["mime"]) else "application/octet-stream")], block)
        if r["to_key"] is None:
            return _warc("response", fields + [("Content-Type", "application/http;msgtype=response")], block)
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(r["to_uri"], r["to_date"], r["to_key"], digest)),
                   ("WARC-Refers-To-Target-URI", r["to_uri"]), ("WARC-Refers-To-Date", r["to_date"])]
        return _warc("revisit", fields + [("Content-Type", "application/http;msgtype=response")], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _warc("warcinfo", [("WARC-Date", _iso(ARC_DATE)), ("WARC-Record-ID", _record_id("warcinfo:", _iso(ARC_DATE), None, "")),
                                  ("Content-Type", "application/warc-fields")], b"software: stepwise\r\nformat: WARC File Format 1.0\r\n")
        parts, size = [], 0

        def close() -> pa.RecordBatch:
            # the writer ends each row with the last line break
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-2]], pa.binary())], ["content"])

        for b in slices(batches, "payload", limit):
            for r in b.to_pylist():
                parts = parts or [info]
                parts.append(record(r))
                size += len(parts[-1])
                if size >= limit:
                    yield close()
                    parts, size = [], 0
        if parts:
            yield close()

    return records.mapInArrow(run, "content binary")


def write_warc(archives: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file per archive, through Spark's own writer (any store Spark can write)."""
    (archives.select(F.col("content").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", 1).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record, found by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, size = end + 4, int(fields["content-length"])
        if at + size > len(data):
            raise ValueError("WARC record is shorter than its declared length")
        yield fields, data[at: at + size]
        at += size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response, resource and revisit records of the archives below ``path``; digests of
    responses are recomputed from the payload and must agree with the header."""
    names = ["key", "record_id", "record_type", "uri", "date", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows = []
                for f, block in parse_warc(data.as_py()):
                    if f["warc-type"] not in ("response", "revisit", "resource"):
                        continue
                    _, body, http = _http_split(block) if f["warc-type"] != "resource" else (b"", block, {})
                    key, digest = http.get(KEY_HEADER.lower()), f["warc-payload-digest"].removeprefix("sha1:")
                    full = f["warc-type"] != "revisit"
                    if full and sha1_base32(body) != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    size = len(body) if full else int(http.get("content-length", 0))
                    rows.append((int(key) if key else None, f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f["warc-date"],
                                 size, digest, f.get("warc-refers-to"), body if full else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "key long, record_id string, record_type string, uri string, date string, payload_bytes long, "
                                 "payload_digest string, refers_to_id string, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``, the key of the response that a revisit cites."""
    slim = records.drop("payload")
    found = (slim.where("record_type = 'response'").groupBy(F.col("record_id").alias("_rid")).agg(F.max("key").alias("refers_to")))
    cited = slim.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("_rid")).distinct()
    return slim.join(found.join(cited, "_rid", "left_semi"), F.col("refers_to_id") == F.col("_rid"), "left").drop("_rid")
