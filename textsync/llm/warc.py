"""WARC records in ZIP packages: a Spark writer, and a reader that range-reads records without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsync.session import new_folder

#: Fixed values of the ZIP format: signatures, and the 16- and 32-bit values that point to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Bytes of records in a package before the next one begins; bytes of the end record and the longest comment.
PACKAGE, TAIL = 64 << 20, 22 + 0xFFFF
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    """A member of a package as its central directory has it."""

    name: str
    method: int
    size: int
    stored: int
    header: int


class RangeFile:
    """Reads ranges of one file in any store that Arrow can open; nothing else of it is read."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, length: int) -> bytes:
        found = self.file.read_at(length, at)
        if len(found) != length:
            raise ValueError("the file ends inside a range")
        return found


def _wide(extra: bytes, wanted: list[bool], values: list[int]) -> list[int]:
    """Values of a directory entry, those at their limit replaced from its ZIP64 field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, out, place = extra[at + 4 : at + 4 + length], list(values), 0
            for i, is_full in enumerate(wanted):
                if is_full:
                    out[i] = struct.unpack_from("<Q", body, place)[0]
                    place += 8
            return out
        at += 4 + length
    return values


def directory(file: RangeFile) -> list[Member]:
    """Members of a ZIP package from its central directory, ZIP64 or not; two or three range reads."""
    begin = max(0, file.size - TAIL)
    tail = file.read(begin, file.size - begin)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, length, offset, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if count == FULL16 or length == FULL32 or offset == FULL32:
        where = struct.unpack("<IIQI", file.read(begin + at - 20, 20))
        if where[0] != LOCATOR:
            raise ValueError("no locator of a ZIP64 directory")
        end = struct.unpack("<IQHHIIQQQQ", file.read(where[2], 56))
        if end[0] != END64:
            raise ValueError("no end of a ZIP64 directory")
        count, length, offset = end[7], end[8], end[9]
    body, members, at = file.read(offset, length), [], 0
    for _ in range(count):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", body, at)
        if head[0] != CENTRAL:
            raise ValueError("not an entry of a central directory")
        stored, size, names, extras, notes, header = head[8], head[9], head[10], head[11], head[12], head[16]
        name = body[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra = body[at + 46 + names : at + 46 + names + extras]
        size, stored, header = _wide(extra, [size == FULL32, stored == FULL32, header == FULL32], [size, stored, header])
        members.append(Member(name, head[4], size, stored, header))
        at += 46 + names + extras + notes
    return members


def member_start(file: RangeFile, member: Member) -> int:
    """Where the data of a stored member begins; a compressed member cannot be read in ranges."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = struct.unpack("<IHHHHHIIIHH", file.read(member.header, 30))
    if head[0] != LOCAL:
        raise ValueError("no header of a member")
    return member.header + 30 + head[9] + head[10]


class Package:
    """Writes stored members one after the other, with ZIP64 fields throughout; one pass, no seeking.

    Sizes and checksums follow the data in a descriptor, so a member's length need not be known before."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.header, self.crc = raw, self.at, 0
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.start = self.at

    def add(self, data: bytes) -> int:
        """Append to the current member; returns where in the member the data begins."""
        place = self.at - self.start
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return place

    def finish(self) -> None:
        size = self.at - self.start
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.header))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, header in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        length, at, n = self.at - begin, self.at, len(self.entries)
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, begin))
        self._put(struct.pack("<IIQI", LOCATOR, 0, at, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        self.out.close()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format asks for it


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One record as a gzip member of its own, and its payload's digest. A revisit has headers only."""
    digest, kind = payload_digest(payload), "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush(), digest


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str
    kind: str
    digest: str
    refers_to: int | None
    payload_bytes: int
    payload: bytes | None


def parse(data: bytes) -> Record:
    """A record from its gzip member; a response's payload is checked against length and digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])

    def page(text: str | None) -> int | None:
        return int(text[10:-1]) if text and text[10:-1] else None

    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its record")
    return Record(page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), kind, digest, page(fields.get("WARC-Refers-To")), length, payload if kind == "response" else None)


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add ``refers_to``: for pages whose payload another page of smaller id also has, that smallest id.

    Payloads of under ``least`` bytes are never referred to. Only ids and digests are grouped; pages then
    meet the ids of repeated payloads by id, so a payload that a third of all pages share is no hot key.
    A page with a null id is referred to by none and refers to none. Rows that share the smallest id of
    their payload are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_bytes")).where(f"page_id IS NOT NULL AND _bytes >= {int(least)}")
    first = keyed.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).where("_first <> _last")
    again = keyed.join(first, "_digest").where("page_id <> _first").select("page_id", "_digest", F.col("_first").alias("refers_to")).distinct()
    told = pages.withColumn("_digest", F.sha2(payload, 256))
    return told.join(again, ["page_id", "_digest"], "left").select("page_id", "url", "html", "refers_to")


def write_packages(pages: DataFrame, folder: str, limit: int = PACKAGE) -> DataFrame:
    """Write ``pages(page_id, url, html, refers_to)`` as packages in ``folder``: ``(package, records, bytes)``.

    Each task writes packages of its own rows, a new one after ``limit`` bytes; a package is a ZIP file
    with one stored member of gzip records and one stored index member. Names are unique to the attempt,
    and only the packages of the attempt that succeeded are returned, so a repeated task does no harm.
    Null html is an empty payload. ``folder`` must be in a store that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        made, package, index, name = [], None, [], ""

        def close() -> None:
            nonlocal package
            package.finish()
            package.begin(INDEX)
            package.add("".join(json.dumps(x) + "\n" for x in index).encode())
            package.finish()
            package.close()
            made.append((f"{folder}/{name}", len(index), package.at))
            package = None

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*[(x.as_py() for x in c) for c in columns]):
                if package is None:
                    index, name = [], f"{uuid.uuid4().hex}.zip"
                    package = Package(system.open_output_stream(f"{base}/{name}"))
                    package.begin(RECORDS)
                data, digest = record(page_id, url, (html or "").encode(), refers_to)
                index.append({"page": page_id, "digest": digest, "offset": package.add(data), "length": len(data)})
                if package.at >= limit:
                    close()
        if package is not None:
            close()
        yield pa.RecordBatch.from_pydict({"package": pa.array([m[0] for m in made], pa.string()), "records": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    return pages.mapInArrow(run, "package string, records long, bytes long")


#: Records fetched by one range read at most, and bytes of it.
TOGETHER, RANGE = 512, 4 << 20


def read_packages(packages: DataFrame) -> DataFrame:
    """Read ``packages(package)`` back: ``(package, page_id, url, record_type, payload_digest, refers_to,
    payload_bytes, payload)``, one row a record; the payload of a revisit is null.

    A first task a package parses the central directory and the index; the index's entries are dealt out
    in runs of neighbouring records, and each run is one range read. Members are never extracted.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file = RangeFile(uri)
                members = {m.name: m for m in directory(file)}
                start = member_start(file, members[RECORDS])
                index = members[INDEX]
                entries = [json.loads(x) for x in file.read(member_start(file, index), index.size).decode().splitlines()]
                begin, runs = 0, []
                for i, e in enumerate(entries):
                    if i > begin and (i - begin >= TOGETHER or e["offset"] + e["length"] - entries[begin]["offset"] > RANGE):
                        runs.append((begin, i))
                        begin = i
                if entries:
                    runs.append((begin, len(entries)))
                yield pa.RecordBatch.from_pydict({
                    "package": pa.array([uri] * len(runs), pa.string()),
                    "at": pa.array([start + entries[a]["offset"] for a, _ in runs], pa.int64()),
                    "lengths": pa.array([[e["length"] for e in entries[a:b]] for a, b in runs], pa.list_(pa.int64())),
                })

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, lengths in zip(*[c.to_pylist() for c in batch.columns]):
                data = RangeFile(uri).read(at, sum(lengths))
                ends = np.cumsum([0, *lengths])
                found = [parse(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_pydict({
                    "package": pa.array([uri] * len(found), pa.string()),
                    "page_id": pa.array([r.page_id for r in found], pa.int64()),
                    "url": pa.array([r.url for r in found], pa.string()),
                    "record_type": pa.array([r.kind for r in found], pa.string()),
                    "payload_digest": pa.array([r.digest for r in found], pa.string()),
                    "refers_to": pa.array([r.refers_to for r in found], pa.int64()),
                    "payload_bytes": pa.array([r.payload_bytes for r in found], pa.int64()),
                    "payload": pa.array([r.payload for r in found], pa.binary()),
                })

    runs = packages.select("package").mapInArrow(listed, "package string, at long, lengths array<long>")
    dealt = runs.repartition(packages.sparkSession.sparkContext.defaultParallelism * 2)
    return dealt.mapInArrow(
        fetched,
        "package string, page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary",
    )


def package_folder(spark) -> str:
    """A new folder for packages in the cluster's shared store."""
    folder = new_folder(spark, "warc")
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")
