"""Legacy ARC archives converted to WARC, and both read back.

An ARC file begins with a version block that names the fields of its header lines; version 1 lines have
five fields and version 2 lines ten, the last being the declared length of what follows. Conversion parses
each header line by the fields of its file, takes the declared bytes, and synthesises what WARC asks for: a
record id from what identifies the capture, an ISO timestamp, the record type and SHA-256 digests. Equal
payloads of some length are stored once: the capture of the smallest id is a ``response``, the others are
``revisit`` records that keep the HTTP header and name it.

Archives are files in the shared folder, compressed record by record. A task writes files under names of its
own and reports them in a manifest table once they are closed; only what the manifest names is ever read,
so a task that is lost or run twice leaves a file that nothing refers to. Payloads are never shuffled:
decisions about revisits travel as digests, and conversion reads records at their offsets.

Null bodies are empty payloads, null addresses are ``about:blank``, addresses lose white space and control
characters. Payloads below :data:`LEAST_REVISIT` bytes are always responses. Repeated ids are captures of their
own; among equal payloads of the same smallest id each is a response.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import written
from ragspark.session import fresh_dir

#: Bytes of a payload from which equal ones are stored once.
LEAST_REVISIT = 100
#: Bytes of an archive, before compression, after which the next one is begun.
ARCHIVE_BYTES = 64 << 20
_LEVEL = 1
_MOST_TASKS = 100_000

# Fixed values of the formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- files in the store -------------------------------------------------------------------------------------


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ArchiveWriter:
    """Appends separately compressed records to files in a folder."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.store, self.folder = _store(folder)
        self.uri, self.suffix, self.out, self.name = folder, suffix, None, None
        self.store.create_dir(self.folder, recursive=True)

    def begin(self) -> str:
        self.close()
        self.name = f"{uuid4().hex}.{self.suffix}.gz"
        self.out, self.size, self.plain = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
        return self.name

    def full(self) -> bool:
        return self.out is None or self.plain >= ARCHIVE_BYTES

    def add(self, record: bytes) -> tuple[str, int, int]:
        """Path, offset and compressed length of the record."""
        packed = gzip.compress(record, _LEVEL, mtime=0)
        at = self.size
        self.out.write(packed)
        self.size += len(packed)
        self.plain += len(record)
        return f"{self.uri}/{self.name}", at, len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class ArchiveReader:
    """Reads records of one file at a time, by offset or from the start."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def open(self, path: str):
        if path != self.path:
            self.close()
            store, name = _store(path)
            self.path, self.file = path, store.open_input_file(name)
        return self.file

    def at(self, path: str, offset: int, length: int) -> bytes:
        file = self.open(path)
        file.seek(offset)
        return gzip.decompress(file.read(length))

    def all(self, path: str) -> Iterator[tuple[int, int, bytes]]:
        """Offset, compressed length and body of each record; holds one record and one block of the file."""
        file = self.open(path)
        file.seek(0)
        at, start, block = 0, 0, b""
        unpack, parts = zlib.decompressobj(31), []
        while True:
            if not block:
                block = file.read(1 << 20)
                if not block:
                    break
            parts.append(unpack.decompress(block))
            rest = unpack.unused_data if unpack.eof else b""
            at += len(block) - len(rest)
            block = rest
            if unpack.eof:
                yield start, at - start, b"".join(parts)
                start, unpack, parts = at, zlib.decompressobj(31), []
        if parts and any(parts):
            raise ValueError(f"{self.path} ends inside a record")

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.path, self.file = None, None


# -- ARC ------------------------------------------------------------------------------------------------------


def version_block(name: str, version: int, date: str) -> bytes:
    """First record of an ARC file: its own header line, version line and the fields of later lines."""
    body = f"{version} 0 corpus\n{' '.join(ARC_FIELDS[version])}\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200",
           "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(own[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, values: dict[str, str], body: bytes) -> bytes:
    values = values | {"Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


@dataclass
class ArcRecord:
    """Named header fields and the bytes that the header declares."""

    fields: dict[str, str]
    body: bytes


def parse_version_block(record: bytes) -> tuple[int, tuple[str, ...]]:
    """Version and field names of an ARC file, from its first record."""
    _, _, rest = record.partition(b"\n")
    lines = rest.split(b"\n")
    version = int(lines[0].split(b" ")[0])
    names = tuple(lines[1].decode().split(" "))
    if version not in ARC_FIELDS or names[-1] != "Archive-length" or names[0] != "URL":
        raise ValueError(f"not an ARC version block: {record[:80]!r}")
    return version, names


def parse_arc(record: bytes, names: tuple[str, ...]) -> ArcRecord:
    """A record by the field names of its file. An address may hold blanks; fields are counted from the end."""
    line, _, rest = record.partition(b"\n")
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(parts) != len(names):
        raise ValueError(f"header line with {len(parts)} of {len(names)} fields: {line[:80]!r}")
    fields = dict(zip(names, parts))
    length = int(fields["Archive-length"])
    if len(rest) < length:
        raise ValueError(f"{length} bytes declared, {len(rest)} found: {line[:80]!r}")
    return ArcRecord(fields, rest[:length])


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header (with the empty line) and payload of an HTTP response; a body without a header is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


_ID = re.compile(rb"\r\nX-Capture-Id: (-?[0-9]+)\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")


def http_response(capture: int | None, payload: bytes) -> bytes:
    own = "" if capture is None else f"X-Capture-Id: {capture}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _number(pattern: re.Pattern, header: bytes) -> int | None:
    found = pattern.search(header)
    return int(found[1]) if found else None


_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\s]+")


def write_arcs(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20200101000000") -> DataFrame:
    """A manifest ``path, version`` of ARC files with a record per row; versions 1 and 2 take turns over tasks and files."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        writer, at, done = ArchiveWriter(folder, "arc"), task.partitionId() if task else 0, []
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for own, address, body in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    if writer.full():
                        at += 1
                        version = 1 + at % 2
                        done.append((f"{folder}/{writer.begin()}", version))
                        writer.add(version_block(writer.name, version, date))
                    address = _UNSAFE.sub("", address or "") or "about:blank"
                    values = {"URL": address, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Filename": writer.name}
                    writer.add(arc_record(version, values, http_response(own, (body or "").encode("utf-8", "replace"))))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([v for _, v in done], pa.int32())], ["path", "version"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return written(rows.mapInArrow(run, "path string, version int"), "arc-manifest")


def read_arcs(manifest: DataFrame) -> DataFrame:
    """``path, offset, length, fields, capture, payload_bytes, digest`` of each record; version blocks set the names."""

    def run(batches):
        reader = ArchiveReader()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, names = [], None
                for offset, length, raw in reader.all(path):
                    if names is None:
                        _, names = parse_version_block(raw)
                        continue
                    record = parse_arc(raw, names)
                    header, payload = split_http(record.body)
                    rows.append((path, offset, length, list(names), _number(_ID, header), len(payload), sha256(payload).hexdigest()))
                columns = list(zip(*rows)) or [[]] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "offset", "length", "fields", "capture", "payload_bytes", "digest"])
        reader.close()

    return _a_file_a_task(manifest.select("path"), manifest).mapInArrow(run, "path string, offset long, length long, fields array<string>, capture long, payload_bytes long, digest string")


def _a_file_a_task(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows by the file they name, in as many partitions as the manifest has files.

    Left to itself Spark would judge the names by their few bytes and put all files in one task.
    """
    return rows.repartition(min(_MOST_TASKS, max(1, manifest.count())), "path")


# -- WARC -----------------------------------------------------------------------------------------------------


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(repr=False, default=b"")

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.headers | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> WarcRecord:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    length = int(headers["Content-Length"])
    if len(rest) < length:
        raise ValueError(f"{length} bytes declared, {len(rest)} found")
    return WarcRecord(headers, rest[:length])


def timestamp(date: str) -> str:
    """ISO form of an ARC date; versions write 14 digits, old files fewer."""
    digits = (date + "00000101000000"[len(date) :]) if len(date) < 14 else date[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(capture: int | None, fields: dict[str, str], digest: str) -> str:
    """The same capture always gets the same id."""
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{capture} {fields["URL"]} {fields["Archive-date"]} {digest}')}>"


def convert(record: ArcRecord, digest: str, refers_to: int | None, revisit: bool) -> WarcRecord:
    """WARC form of an ARC record, as a response or as a revisit of the capture ``refers_to``."""
    header, payload = split_http(record.body)
    capture = _number(_ID, header)
    block = header if revisit else record.body
    headers = {
        "WARC-Type": "revisit" if revisit else "response" if header else "resource",
        "WARC-Record-ID": record_id(capture, record.fields, digest),
        "WARC-Date": timestamp(record.fields["Archive-date"]),
        "WARC-Target-URI": record.fields["URL"],
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response" if header else record.fields["Content-type"],
    }
    if revisit:
        headers |= {"WARC-Profile": IDENTICAL, "X-Refers-To-Capture": str(refers_to)}
    return WarcRecord(headers, block)


def decisions(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``records`` with ``refers_to``, the smallest capture of an equal payload, where they revisit it."""
    long = records.filter(F.col("payload_bytes") >= least)
    first = long.groupBy("digest").agg(F.min("capture").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = records.join(first, "digest", "left")
    again = (F.col("payload_bytes") >= least) & (F.col("first") < F.col("capture"))
    return joined.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_warcs(decided: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """A manifest ``path`` of WARC files converted from the ARC records of ``decided``, in the order they lie in.

    ``manifest`` names the ARC files.
    """

    def run(batches):
        reader, writer, done = ArchiveReader(), ArchiveWriter(folder, "warc"), []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "offset", "length", "fields", "digest", "refers_to"))
            for path, offset, length, names, digest, refers_to in zip(*columns):
                if writer.full():
                    done.append(f"{folder}/{writer.begin()}")
                    about = f"software: corpus converter\r\nformat: WARC File Format 1.1\r\nsource: {path.rpartition('/')[2]}\r\n".encode()
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid5(NAMESPACE_URL, writer.name)}>", "WARC-Date": timestamp("2020"), "WARC-Filename": writer.name, "Content-Type": "application/warc-fields"}
                    writer.add(WarcRecord(info, about).dump())
                record = parse_arc(reader.at(path, offset, length), tuple(names))
                writer.add(convert(record, digest, refers_to, refers_to is not None).dump())
        writer.close()
        reader.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    ordered = _a_file_a_task(decided, manifest).sortWithinPartitions("path", "offset")
    return written(ordered.mapInArrow(run, "path string"), "warc-manifest")


def read_warcs(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date`` of each capture.

    Digests of blocks and of stored payloads are verified; one that fails raises an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def row(record: WarcRecord) -> tuple:
        h = record.headers
        header, payload = split_http(record.block)
        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
        whole = h["WARC-Type"] != "revisit"
        if h["WARC-Block-Digest"] != f"sha256:{sha256(record.block).hexdigest()}" or whole and sha256(payload).hexdigest() != digest:
            raise ValueError(f"a digest of {h['WARC-Record-ID']} does not hold")
        size = len(payload) if whole else _number(_LENGTH, header)
        refers_to = None if whole else int(h["X-Refers-To-Capture"])
        return _number(_ID, header), size, digest, h["WARC-Type"], refers_to, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]

    def run(batches):
        reader = ArchiveReader()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = [row(r) for _, _, raw in reader.all(path) if (r := parse_warc(raw)).headers["WARC-Type"] != "warcinfo"]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        reader.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"
    return _a_file_a_task(manifest.select("path"), manifest).mapInArrow(run, schema)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to ARC files, those to WARC files, and what reading the WARC files gives."""
    spark = pages.sparkSession
    arcs = write_arcs(pages, fresh_dir(spark, "arc"), page_id, url, html)
    records = written(read_arcs(arcs), "arc-records")
    warcs = write_warcs(decisions(records), arcs, fresh_dir(spark, "warc"))
    return read_warcs(warcs)
