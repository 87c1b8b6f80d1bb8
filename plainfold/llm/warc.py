"""Legacy archives (ARC versions 1 and 2) to WARC/1.1, written as archives and read back.

An ARC file begins with a version block, a record ``filedesc://...`` whose body names the file's version and the fields of
its header lines. A record is such a line, ``length`` bytes as that line declares, and a newline. Version 1 has five fields
(URL, IP address, date, content type, length), version 2 ten (with result code, checksum, location, offset and file name
before the length); fields are parsed by the list that the file itself gives and the body is cut by the declared length,
never by looking for the next header. ``read_arcs`` reads such files, compressed or not; pages that come as rows are
first made into records of such files. From these the converter makes what WARC asks for and ARC lacks: a record id (a
version 8 UUID that holds the row's id), an ISO date from the 14 digits, record and block types, and SHA-256 digests
of block and payload. Records whose payloads are equal and have at least ``least`` bytes are written once, as the
response with the smallest id; the others become revisits that refer to it.

Archives are files of WARC records one after another, compressed by gzip, written by Spark's text writer and read by its
binaryFile reader, so that both work on any store Spark reaches. How many records one may hold hangs on their size
(``CLASSES``), so that it stays under about 64 MB before compression unless one record is longer. Records are read by their
Content-Length, one at a time.

Defined results: a null payload is empty; a null URL becomes ``unknown:``; repeated ids count once and rows without id
take no part (``one_per_id``); an empty table makes no archive and an empty result; very long payloads are taken whole, up
to the 2 GB that a value may have. Other columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_per_id, save, work

# The header fields of both ARC versions, in order, as version blocks name them.
NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEYS = {
    "URL": "url", "IP-address": "ip", "Archive-date": "date", "Content-type": "type", "Result-code": "result", "Checksum": "checksum",
    "Location": "location", "Offset": "offset", "Filename": "filename", "Archive-length": "length",
}
FIELDS = {version: tuple(KEYS[n] for n in names.split()) for version, names in NAMES.items()}
#: Payloads under so many bytes: so many records a file.
CLASSES = ((1 << 15, 2000), (1 << 20, 64), (1 << 25, 2), (1 << 62, 1))
SALTS = 8  #: parts that rows of a digest are dealt to
CRLF = b"\r\n"
DATE = "20260101000000"  #: pages carry no date
HOLD = 1 << 22  #: bytes of blocks that a reader passes on at once


def arc_record(version: int, url: str, content_type: str, body: bytes, ip: str = "0.0.0.0", date: str = DATE) -> bytes:
    """An ARC record of either version."""
    values = {"url": url, "ip": ip, "date": date, "type": content_type, "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "-", "length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def version_block(version: int, name: str) -> bytes:
    """What an ARC file begins with."""
    return arc_record(version, f"filedesc://{name}", "text/plain", f"{version} 0 plainfold\n{NAMES[version]}\n".encode())


def _records(stream: BinaryIO, fields: tuple[str, ...]) -> Iterator[tuple[dict, bytes]]:
    """Header fields and body of each record. Raises ValueError where a header or a declared length doesn't hold."""
    while line := stream.readline():
        if not line.endswith(b"\n"):
            raise ValueError("the file ends within a header")
        # The content type may hold blanks, so fields are counted from both ends.
        parts = line[:-1].decode("utf-8", "surrogateescape").split(" ")
        extra = len(parts) - len(fields)
        if extra < 0:
            raise ValueError(f"ARC header with {len(parts)} fields instead of {len(fields)}")
        parts[3 : 4 + extra] = [" ".join(parts[3 : 4 + extra])]
        head = dict(zip(fields, parts, strict=True))
        size = int(head["length"])
        body = stream.read(size)
        if len(body) < size or stream.read(1) not in (b"\n", b""):
            raise ValueError("the declared length doesn't fit the record")
        yield head, body


def parse_arc(data: bytes, version: int) -> Iterator[tuple[dict, bytes]]:
    """Records without a version block before them."""
    return _records(io.BytesIO(data), FIELDS[version])


def read_arc(stream: BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """The records of an ARC file, parsed as its version block says. Holds one at a time."""
    line = stream.readline()
    if not line:
        return
    parts = line.decode("utf-8", "surrogateescape").split()
    if not line.startswith(b"filedesc:") or not parts[-1].isdigit():
        raise ValueError("the file has no version block")
    body = stream.read(int(parts[-1])).decode("utf-8", "surrogateescape").split("\n")
    if stream.read(1) not in (b"\n", b""):
        raise ValueError("the declared length doesn't fit the version block")
    version, names = body[0].split(" ")[0], body[1].split() if len(body) > 1 else []
    if version not in map(str, NAMES) or not set(names) <= set(KEYS) or not {"URL", "Archive-date", "Archive-length"} <= set(names):
        raise ValueError(f"ARC version {version!r} with the fields {names}")
    if len(parts) != len(names):
        raise ValueError(f"a version block of {len(parts)} fields in a file of {len(names)}")
    yield from _records(stream, tuple(KEYS[n] for n in names))


class Joined(io.RawIOBase):
    """Parts, one after another, as a stream."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.rest = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.rest = memoryview(part)
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return head + b"\r\n\r\n", payload


def record_id(row: int) -> str:
    """A UUID of version 8: the 64 bits of ``row`` around version and variant, the rest a hash of them, so that a revisit
    can name the response's record by the response's row."""
    h = f"{row & (1 << 64) - 1:016x}"
    tail = hashlib.sha256(h.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}{tail[:2]}-{tail[2:14]}>"


def row_of(id_: str) -> int:
    h = id_.removeprefix("<urn:uuid:").replace("-", "")
    row = int(h[:12] + h[13:16] + h[17], 16)
    return row - (1 << 64) if row >> 63 else row


def warc_record(row: int, head: dict, block: bytes, refers_to: int | None) -> bytes:
    """The WARC record of a parsed ARC record: a response, or a revisit where ``refers_to`` names the response."""
    http, payload = split_http(block)
    digest = hashlib.sha256(payload).hexdigest()
    d = head["date"] + "00000101000000"[len(head["date"]) :]  # a date cut short means its beginning
    ip = head.get("ip", "0.0.0.0")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(row)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {head.get('url') or head['target']}", f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        block = http
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(x.encode("utf-8", "surrogateescape") for x in lines) + CRLF + CRLF + block + CRLF + CRLF


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and block of each record, cut by Content-Length. Holds one record at a time."""
    while first := stream.readline():
        if first == CRLF:  # between records
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {stream.tell()}")
        head = {}
        while (line := stream.readline()) != CRLF:
            if not line:
                raise ValueError("the archive ends within a header")
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogateescape")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a block")
        yield head, block


def legacy(version: int, url: str | None, payload: bytes) -> bytes:
    """A page as a record of an ARC file."""
    # Header fields are separated by blanks and end with the line.
    safe = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "unknown:"
    return arc_record(version, safe, "text/html", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload))


def _from_arc(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, bytes]]:
    """Row of the batch, header fields and body of each page, by way of an ARC file of either version: even ids 1, odd ids 2."""
    ids = batch.column("page_id").to_numpy()
    for version in NAMES:
        rows = [i for i, id_ in enumerate(ids) if 1 + id_ % 2 == version]
        if rows:
            made = (legacy(version, batch.column("url")[i].as_py(), batch.column("html")[i].as_py() or b"") for i in rows)
            file = io.BufferedReader(Joined(chain([version_block(version, f"pages-{version}.arc")], made)), HOLD)
            for i, (head, body) in zip(rows, read_arc(file), strict=True):
                yield i, head, body


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, digests, sizes = [], [], []
        for i, _, block in _from_arc(batch) if "url" in batch.schema.names else _as_read(batch):
            payload = split_http(block)[1]
            rows.append(i)
            digests.append(hashlib.sha256(payload).digest())
            sizes.append(len(payload))
        yield pa.record_batch({"page_id": batch.column("page_id").take(pa.array(rows, pa.int64())), "digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int64())})


def _as_read(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, bytes]]:
    """The same of records that come from ARC files."""
    for i in range(batch.num_rows):
        yield i, {k: batch.column(k)[i].as_py() for k in HEAD}, batch.column("block")[i].as_py()


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records, passed on about ``HOLD`` bytes at a time."""
    for batch in batches:
        out, size = [], 0
        for i, head, block in _from_arc(batch) if "url" in batch.schema.names else _as_read(batch):
            out.append(warc_record(batch.column("page_id")[i].as_py(), head, block, batch.column("refers_to")[i].as_py())[:-2])  # the writer ends the record
            size += len(out[-1])
            if size > HOLD:
                yield pa.record_batch({"record": pa.array(out, pa.binary())})
                out, size = [], 0
        if out:
            yield pa.record_batch({"record": pa.array(out, pa.binary())})


HEAD = ("target", "ip", "date")


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, n, target, ip, date, block of each record of ARC files, compressed where they begin as gzip does."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = io.BytesIO(content.as_py())
            if file.getvalue()[:2] == b"\x1f\x8b":
                file = gzip.GzipFile(fileobj=file)
            for n, (head, block) in enumerate(read_arc(file)):
                yield pa.record_batch({
                    "path": pa.array([path]), "n": pa.array([n]), "target": pa.array([head["url"]]), "ip": pa.array([head.get("ip", "0.0.0.0")]),
                    "date": pa.array([head["date"]]), "block": pa.array([block], pa.binary()),
                })


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """page_id (64 bits of a hash of file and place), target, ip, date, block: the records of ARC files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_arc_rows, "path string, n long, target string, ip string, date string, block binary")
    return rows.select(F.xxhash64("path", "n").alias("page_id"), *HEAD, "block")


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("block", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of compressed archives, passed on about ``HOLD`` bytes at a time."""
    def passed(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD.types, strict=True)], schema=RECORD)

    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for head, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(data.as_py()))):
                rows.append(_row(head, block))
                size += len(block)
                if size > HOLD:
                    yield passed(rows)
                    rows, size = [], 0
            if rows:
                yield passed(rows)


def _row(head: dict, block: bytes) -> tuple:
    """A record's columns. Raises ValueError where a digest doesn't hold."""
    digest, payload = head["warc-payload-digest"].removeprefix("sha256:"), None
    if head["warc-type"] == "response":
        payload = split_http(block)[1]
    whole = hashlib.sha256(block).hexdigest() == head["warc-block-digest"].removeprefix("sha256:")
    if not whole or payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"digest of {head['warc-record-id']}")
    size = int(head["warc-payload-length"]) if payload is None else len(payload)
    refers = head.get("warc-refers-to")
    return row_of(head["warc-record-id"]), size, digest, head["warc-type"], row_of(refers) if refers else None, head["warc-target-uri"], block


def write_archives(pages: DataFrame, path: str, *, least: int = 100, records: int = 2000) -> None:
    """Convert the pages (page_id, url, html), or the records of ``read_arcs``, and write WARC files of at
    most ``records`` records each below ``path``."""
    at = work(pages.sparkSession)
    if "block" in pages.columns and "target" in pages.columns and "html" not in pages.columns:
        pages, body = pages.select("page_id", *HEAD, "block"), "block"
    else:
        pages = one_per_id(pages, "page_id", "url", "html").select("page_id", "url", F.col("html").cast("binary").alias("html"))
        body = "html"
    digests = save(pages.mapInArrow(_digests, "page_id long, digest binary, size long"), at, "digests")
    of_size = F.coalesce(*(F.when(F.col("size") < most, i) for i, (most, _) in enumerate(CLASSES)))
    there = [r["of"] for r in digests.select(of_size.alias("of")).distinct().collect()]  # CLASSES at most
    # A digest's rows are dealt to parts, and what stands for the digest goes to each.
    first = digests.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = digests.where(F.col("size") >= least).withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = save(dealt.join(first, ["digest", "part"]).where("page_id != refers_to").select("page_id", "refers_to"), at, "revisits")
    marked = pages.join(revisits, "page_id", "left").withColumn("size", F.coalesce(F.octet_length(body), F.lit(0)))
    for i in sorted(there) or [0]:
        rows = marked if len(there) < 2 else marked.where(of_size == i)
        rows = rows.drop("size").mapInArrow(_convert, "record binary").select(F.col("record").cast("string").alias("value"))
        rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", min(records, CLASSES[i][1])).text(f"{path}/class{i}")


def read_archives(df_session, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, uri, block: one row a record."""
    files = df_session.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, block binary")


def convert(pages: DataFrame, **how) -> DataFrame:
    path = f"{work(pages.sparkSession)}/archives"
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)
