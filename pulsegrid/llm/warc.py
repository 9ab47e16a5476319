"""Legacy ARC archives converted to WARC, and WARC files written and read.

An ARC file starts with a version block: its URL record names the version, and a second line names the
fields of every later record. Version 1 has five fields (URL, IP address, date, type, length), version 2
ten, with result code, checksum, location, offset and file name between. A record's body is exactly its
declared length. Each ARC record becomes a WARC record with a synthesised identifier (from URL, date and
digest), timestamp (14-digit date as ISO 8601), type and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import Scratch

#: Payloads shorter than this are stored again instead of referred to.
REVISIT_BYTES = 1000
#: Rows of the table of revisits that are broadcast at most.
BROADCAST_ROWS = 1_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

V1_FIELDS = ("url", "ip", "date", "type", "length")
V2_FIELDS = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes
    page: str | None = field(default=None)

    @property
    def payload(self) -> bytes:
        if self.headers.get("Content-Type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def arc_line(url: str, date: str, kind: str, length: int, version: int = 1, ip: str = "0.0.0.0", result: int = 200, checksum: str = "-", location: str = "-", offset: int = 0, filename: str = "-") -> bytes:
    """URL record line of an ARC record; spaces and line ends in the URL are percent-encoded."""
    safe = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    parts = [safe, ip, date, kind, str(length)] if version == 1 else [safe, ip, date, kind, str(result), checksum, location, str(offset), filename, str(length)]
    return " ".join(parts).encode() + b"\n"


def arc_header(name: str, date: str, version: int = 1) -> bytes:
    """The version block that begins an ARC file."""
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 PulseGrid\n{names}\n".encode()
    return arc_line(f"filedesc://{name}", date, "text/plain", len(body), version) + body + b"\n"


def read_arc(stream: BinaryIO, version: int | None = None) -> Iterator[ArcRecord]:
    """Records of an ARC stream without the version block. A line that no version fits raises ValueError;
    so does a body that ends before its declared length."""
    names: tuple[str, ...] | None = {1: V1_FIELDS, 2: V2_FIELDS, None: None}[version]
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        width = len(names) if names else (10 if re.fullmatch(r"\S+ \S+ \d{4,14} \S+ -?\d+ \S+ \S+ \d+ \S+ \d+", text) else 5)
        parts = text.rsplit(" ", width - 1)
        if len(parts) != width or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {text[:200]!r}")
        fields = dict(zip(V1_FIELDS if width == 5 else V2_FIELDS, parts, strict=True))
        body = stream.read(int(fields["length"]))
        if len(body) < int(fields["length"]):
            raise ValueError(f"ARC record of {fields['url']!r} ends after {len(body)} of {fields['length']} bytes")
        if fields["url"].startswith("filedesc://"):
            number = body.split(None, 1)[0] if body.strip() else b"1"
            names = V2_FIELDS if number == b"2" else V1_FIELDS
            continue
        yield ArcRecord(fields, body)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_time(date: str) -> str:
    """14-digit (or shorter) ARC date as ISO 8601 in UTC; missing parts are their least."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "00000101000000"[len(digits) :] if len(digits) >= 4 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str, date: str, digest: str, page: str | None = None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page}')}>"


def convert(arc: ArcRecord, page: str | None = None, refers_to: str | None = None) -> WarcRecord:
    """The WARC equivalent of an ARC record: a response if its body starts with an HTTP status line, else a
    resource; with ``refers_to`` (the page of an equal payload), a revisit that holds the HTTP head only."""
    url, body = arc.fields["url"], arc.body
    http = body[:5] == b"HTTP/"
    head, gap, payload = body.partition(b"\r\n\r\n") if http else (b"", b"", body)
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    block = head + gap if kind == "revisit" else body
    digest = _digest(payload)
    headers = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(url, arc.fields["date"], digest, page), "WARC-Date": warc_time(arc.fields["date"]), "WARC-Target-URI": url,
        "WARC-IP-Address": arc.fields["ip"], "WARC-Payload-Digest": digest, "WARC-Block-Digest": _digest(block),
        "Content-Type": "application/http; msgtype=response" if http else arc.fields["type"], "Content-Length": str(len(block)),
    }
    if page is not None:
        headers["X-Page-ID"] = page
    if kind == "revisit":
        headers |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    return WarcRecord(headers, block, page)


def warc_bytes(record: WarcRecord) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + record.block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records have equal bytes."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def unpacked(stream: BinaryIO) -> BinaryIO:
    """A seekable stream, or what its gzip members hold, read as it goes."""
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16) if packed else io.BufferedReader(stream, 1 << 16)


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """Records of a WARC stream, gzip members or plain."""
    stream = unpacked(stream)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        yield WarcRecord(headers, stream.read(int(headers["Content-Length"])), headers.get("X-Page-ID"))


def _open(path: str):
    """File system and path of a URI, for executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write_file(folder: str, name: str, chunks: Iterator[bytes]) -> str:
    """Write under a temporary name, then move: a retried or speculative task leaves one whole file."""
    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    temporary = f"{at}/_{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(temporary, f"{at}/{name}")
    return f"{folder}/{name}"


def convert_files(spark: SparkSession, arcs: list[str], folder: str) -> DataFrame:
    """Convert ARC files (gzip or plain, by URI) to one WARC file each. Returns arc, warc, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column(0).to_pylist():
                system, at = _open(arc)
                made = 0

                def members(stream: BinaryIO):
                    nonlocal made
                    for record in read_arc(stream):
                        made += 1
                        yield member(warc_bytes(convert(record)))

                name = re.sub(r"\.arc(\.gz)?$", "", at.rsplit("/", 1)[-1]) + ".warc.gz"
                with system.open_input_file(at) as f:
                    where = _write_file(folder, name, members(unpacked(f)))
                yield pa.RecordBatch.from_pydict({"arc": [arc], "warc": [where], "records": [made]})

    paths = spark.createDataFrame([(a,) for a in arcs], "arc string").repartition(max(1, len(arcs)))
    return paths.mapInArrow(run, "arc string, warc string, records long")


def write_pages(pages: DataFrame, folder: str, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20260101000000") -> DataFrame:
    """Write a record for each page, as an ARC record converted to WARC; equal payloads are revisits.

    Of pages with equal payloads of at least ``REVISIT_BYTES``, that with the largest key is the response
    and others revisit it. A null html is an empty payload, a null url reads ``-``. A page with a null key
    is always a response. Rows that repeat a key and a payload are all responses if that key is the
    largest. Returns the files (file, records), one per partition that has rows.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    kind = pages.schema[key].dataType.simpleString()
    light = pages.select(F.col(key).alias("key"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    light = scratch.put(light.where((F.col("bytes") >= REVISIT_BYTES) & F.col("key").isNotNull()).select("key", "digest"), "light")
    heads = scratch.put(light.groupBy("digest").agg(F.max("key").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head"), "heads")
    revisits = scratch.put(light.join(heads, "digest").where("key != head").select("key", "digest", "head").distinct(), "revisits")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits, ["key", "digest"], "left").select("key", "url", "html", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def members():
            nonlocal made
            for batch in batches:
                for page, link, text, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = text.encode("utf-8", "surrogatepass")
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                    legacy = io.BytesIO(arc_line(link or "-", date, "text/html", len(body)) + body + b"\n")
                    for record in read_arc(legacy, version=1):
                        made += 1
                        yield member(warc_bytes(convert(record, None if page is None else str(page), None if head is None else str(head))))

        where = _write_file(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz", members())
        if made:
            yield pa.RecordBatch.from_pydict({"file": [where], "records": [made]})

    return scratch.put(rows.withColumn("key", F.col("key").cast(kind)).mapInArrow(run, "file string, records long"), "files")


def read_pages(files: DataFrame, key: str = "page_id") -> DataFrame:
    """Per record of the files: key, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to."""

    def rows_of(path: str):
        system, at = _open(path)
        with system.open_input_file(at) as f:
            for record in read_warc(f):
                h = record.headers
                if h["WARC-Type"] == "revisit":
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", record.block)[1])
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                else:
                    size, digest = len(record.payload), hashlib.sha1(record.payload).hexdigest()
                yield (None if record.page is None else int(record.page), size, digest, h["WARC-Type"], int(h["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in h else None, h["WARC-Record-ID"])

    schema = pa.schema([(key, pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")
