"""WARC records in ZIP packages: write them from a table of pages, find them through the directories, read ranges of them.

A package is a ZIP file with stored (not compressed) members: `archive/data.warc.gz`, a gzip member for each
record, and `indexes/index.cdxj`, a line for each record with its place in the archive. A reader takes the
package's last bytes, its central directory (with ZIP64's where sizes or counts ask for it), the index, and then
ranges of the archive; nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import durable, shared_folder

# Signatures and sizes of ZIP's and ZIP64's structures.
END, END_SIZE, MOST_COMMENT = b"PK\x05\x06", 22, 65535
END64, END64_SIZE, LOCATOR, LOCATOR_SIZE = b"PK\x06\x06", 56, b"PK\x06\x07", 20
CENTRAL, CENTRAL_SIZE, LOCAL, LOCAL_SIZE = b"PK\x01\x02", 46, b"PK\x03\x04", 30
EXTRA64, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE, CDXJ = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"


class Member(NamedTuple):
    name: str
    method: int
    begin: int
    size: int


class Span(NamedTuple):
    """A range of an archive: where it begins in the package, its bytes and how many records begin in it (-1: not known)."""

    begin: int
    size: int
    records: int


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, as executors reach it, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Sink:
    """What zipfile needs of a file that only grows."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.at = out, 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.out.flush()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the http header alone, whose content length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {json.dumps(url)[1:-1] if url is not None else ''}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    head += [f"WARC-Page: {page_id}"] if page_id is not None else []
    head += [] if url is not None else ["WARC-No-URI: true"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To-Page: {refers_to}"] if refers_to is not None else [])]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Package:
    """A package that is being written; `close` gives its row of the manifest."""

    def __init__(self, folder: str, level: int) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"  # each attempt of a task has files of its own
        store, path = file_system(self.path)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(Sink(self.out), "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.level, self.at, self.lines = level, 0, []

    def add(self, data: bytes, entry: dict) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.archive.write(packed)
        self.lines.append(json.dumps(entry | {"offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        with self.zip.open(CDXJ, "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode() + b"\n")
        self.zip.close()
        self.out.close()
        return self.path, self.at, len(self.lines)


MANIFEST = "path string, archive_bytes long, records long"


def with_revisits(pages: DataFrame, key: str, html: str, least: int) -> DataFrame:
    """Add sha1, bytes and the largest page id of the payload (null where it needs no revisits) to pages.

    Sums by payload hold no payload, and have one row a task for a frequent one; where that row then meets
    its pages, Spark splits a large partition (adaptive execution), as nothing needs a payload's pages together.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    p = pages.select(F.col(key).cast("long").alias("page"), F.col("url").cast("string").alias("url"), text.alias("html"), F.unhex(F.sha1(text.cast("binary"))).alias("sha1"), F.octet_length(text).cast("long").alias("bytes"))
    again = p.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumn("shared", F.lit(True))
    return p.join(again, ["sha1", "bytes"], "left")


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", *, least_bytes: int = 0, package_bytes: int = 1 << 28, level: int = 1, date: str = DATE) -> DataFrame:
    """(path, archive_bytes, records) of the packages written in `folder`: a record per row of `pages`, payload the html in UTF-8.

    Of the pages with one payload of at least `least_bytes`, that with the largest id is a response, others revisit it;
    rows that repeat that largest id are responses too, as a revisit of itself says nothing. Null html is an empty payload,
    a null id counts as smaller than all others, a null url stays null.

    A task writes as it reads and begins another package at `package_bytes`; it keeps only the package's index.
    Files that a lost task leaves are in no row, and so never read. The rows are checkpointed, so
    packages aren't written anew when they are read.
    """
    rows = with_revisits(pages.withColumnRenamed(url, "url") if url != "url" else pages, key, html, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page, address, text, sha1, size, last, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or Package(folder, level)
                payload, digest = text.encode(), base64.b32encode(sha1).decode()
                kind = "revisit" if shared and page != last else "response"
                package.add(record(kind, page, address, payload, digest, last if kind == "revisit" else None, date), {"url": address, "digest": f"sha1:{digest}", "status": "200", "mime": "text/html" if kind == "response" else "warc/revisit", "bytes": size})
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    return durable(rows.select("page", "url", "html", "sha1", "bytes", "last", "shared").mapInArrow(run, MANIFEST))


# --- reading


def end_of_directory(file: BinaryIO, size: int) -> tuple[int, int, int]:
    """(begin, bytes, entries) of the central directory, from the end record or, where that is full, ZIP64's."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END, 0, max(0, len(tail) - END_SIZE + len(END)))
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + len(END) - 1)  # the signature can also stand in the comment
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    entries, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == entries or FULL32 in (length, begin):
        at += tail_at - LOCATOR_SIZE
        file.seek(max(0, at))
        locator = file.read(LOCATOR_SIZE)
        if at < 0 or locator[:4] != LOCATOR:
            if FULL32 in (length, begin):
                raise ValueError("ZIP64 values without their directory")
            return begin, length, entries
        file.seek(struct.unpack_from("<Q", locator, 8)[0])
        record64 = file.read(END64_SIZE)
        if record64[:4] != END64:
            raise ValueError("ZIP64's locator leads nowhere")
        entries, length, begin = struct.unpack_from("<QQQ", record64, 32)
    return begin, length, entries


def directory(file: BinaryIO, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, bytes, place of the local header) of each member."""
    begin, length, entries = end_of_directory(file, size)
    file.seek(begin)
    data = file.read(length)
    out, at = [], 0
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL or at + CENTRAL_SIZE > len(data):
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, whole, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", data, at + 20)
        local = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + name_n].decode("utf-8", "replace")
        extra, end = at + CENTRAL_SIZE + name_n, at + CENTRAL_SIZE + name_n + extra_n
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<HH", data, extra)
            if kind == EXTRA64:  # holds those of the values that are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", data, extra + 4))
                whole = next(values) if whole == FULL32 else whole
                packed = next(values) if packed == FULL32 else packed
                local = next(values) if local == FULL32 else local
            extra += 4 + n
        out.append((name, method, packed, local))
        at = end + comment_n
    return out


def stored_members(file: BinaryIO, size: int, wanted: tuple[str, ...]) -> list[Member]:
    """The members whose names begin with one of `wanted`, and where their bytes begin; they must be stored."""
    out = []
    for name, method, n, local in directory(file, size):
        if name.startswith(wanted) and not name.endswith("/"):
            if method:
                raise ValueError(f"{name} is compressed as a whole: only stored members can be read in ranges")
            file.seek(local)
            head = file.read(LOCAL_SIZE)
            if head[:4] != LOCAL:
                raise ValueError(f"{name} has no local header")
            out.append(Member(name, method, local + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26)), n))
    return out


def lines_of(file: BinaryIO, begin: int, size: int, piece: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    for at in range(begin, begin + size, piece):
        file.seek(at)
        *whole, rest = (rest + file.read(min(piece, begin + size - at))).split(b"\n")
        yield from whole
    yield rest


def spans(file: BinaryIO, size: int, span_bytes: int) -> Iterator[Span]:
    """Ranges of whole records, each of about `span_bytes`: by the index, or the whole archive where there is none."""
    members = stored_members(file, size, ("archive/", "indexes/"))
    archives = [m for m in members if m.name.endswith(".warc.gz")]
    indexes = [m for m in members if m.name.endswith(".cdxj")]
    if not indexes or len(archives) != 1:  # an index names no archive, so several have to be walked
        yield from (Span(m.begin, m.size, -1) for m in archives)
        return
    begin, end, records = 0, 0, 0
    for m in indexes:
        for line in lines_of(file, m.begin, m.size):
            if at := line.find(b"{") + 1:
                entry = json.loads(line[at - 1 :])
                offset, length = int(entry["offset"]), int(entry["length"])
                if records and (offset != end or end - begin >= span_bytes):
                    yield Span(archives[0].begin + begin, end - begin, records)
                    records = 0
                begin = begin if records else offset
                end, records = offset + length, records + 1
    if records:
        yield Span(archives[0].begin + begin, end - begin, records)


def gzip_members(file: BinaryIO, begin: int, size: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """Each record of a range, unpacked; a piece of the range and one record are held at a time."""
    at, end, rest = begin, begin + size, b""
    while at < end or rest:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                if at >= end:
                    raise ValueError("the range ends within a record")
                file.seek(at)
                rest = file.read(min(piece, end - at))
                at += len(rest)
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a head, their names in lower case, and what follows it."""
    head, _, body = data.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, body


def parse(data: bytes) -> tuple[int | None, str | None, str, int, str, int | None, bytes | None]:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of a record, digests and lengths held against its bytes."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, rest = headers(data)
    length = int(head["content-length"])
    body = rest[:length]
    if len(body) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {head['warc-record-id']} is not as long as it says")
    http, payload = headers(body)
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if base32_sha1(body) != head["warc-block-digest"].removeprefix("sha1:") or not revisit and (base32_sha1(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"record {head['warc-record-id']} does not have the digest that it states")
    number = lambda name: int(head[name]) if name in head else None
    url = None if "warc-no-uri" in head else json.loads(f'"{head["warc-target-uri"]}"')
    return number("warc-page"), url, head["warc-type"], int(http["content-length"]), digest, number("warc-refers-to-page"), None if revisit else payload


FOUND = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_packages(packages: DataFrame, path_col: str = "path", *, payloads: bool = True, span_bytes: int = 1 << 22) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the packages.

    First each package's directories and index are read, and give ranges of about `span_bytes`; these are dealt out
    evenly, and each is read on its own, record by record. So a large package isn't one task's work.
    payload is null for revisits, and always without `payloads`. Records, directories and ranges that
    don't hold what they say raise an error; a package without records gives no rows.
    """
    span_schema = "path string, begin long, size long, records long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = file_system(path)
                with store.open_input_file(at) as file:
                    found = [(path, *s) for s in spans(file, file.size(), span_bytes)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [c.split()[0] for c in span_schema.split(", ")])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, begin, size, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = file_system(path)
                rows, held, n = [], 0, 0
                with store.open_input_file(at) as file:
                    for data in gzip_members(file, begin, size):
                        *row, payload = parse(data)
                        rows.append((*row, payload if payloads else None))
                        held, n = held + len(data) * payloads + 200, n + 1
                        if held >= span_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])
                            rows, held = [], 0
                if records not in (-1, n):
                    raise ValueError(f"{path}: {n} records where the index has {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    ranges = packages.select(F.col(path_col)).mapInArrow(find, span_schema)
    return ranges.repartition(packages.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(fetch, FOUND)


def archive_pages(pages: DataFrame, folder: str | None = None, *, payloads: bool = True, **options: object) -> DataFrame:
    """Write `pages` as packages in `folder` (by default a new one in the shared folder) and read all their records back."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_packages(write_packages(pages, folder, **options), payloads=payloads)
