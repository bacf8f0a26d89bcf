"""Web records in ZIP packages: a writer, and a reader that needs no extraction.

A package is a ZIP file with stored (not deflated) members: ``archive/data.warc.gz``, whose records are
gzip members of their own, and ``indexes/index.cdx``, one JSON line per record with offset and length
inside the archive member. The reader parses the end record, the ZIP64 locator and end record, the central
directory with its ZIP64 extra fields and the local header of the members it needs; then it reads records by byte range,
near ones with one request.

Pages with equal payloads are stored once: the page with the largest id is the response, the others
revisit it. Texts move once, keyed by page; who revisits whom is found on digests alone, so a payload
that a third of all pages share moves no text to one place. Each task writes packages of about ``max_bytes``
under names of its own, which appear when they are complete; a task that runs again replaces them.

Defined results: null html is an empty payload; a null page id is smaller than any other and comes back
as null; rows that repeat id and payload are records of the same type; a null url gives no target header;
an empty table gives no package and no rows; other columns stay out. Packages without an index or with
compressed archive members are refused with an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.llm.common import Output, file_system, slices
from ticketspark.session import written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Record signatures and sizes of the ZIP format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
NAME_LIMIT = 65_535
CONTROL = re.compile(r"[\x00-\x20\x7f]")
RESPONSE, REVISIT = "response", "revisit"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    part = (name or "null").strip("<>").rpartition(":")[2]
    return None if part == "null" else int(part)


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {REVISIT if revisit else RESPONSE}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_name(refers_to)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Package:
    """Records go straight to the store; the index is held until the archive member is complete."""

    def __init__(self, uri: str):
        self.out = Output(uri)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines, self.at = [], 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed), "filename": ARCHIVE}))
        self.at += len(packed)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(line + "\n" for line in self.lines))
        self.zip.close()
        self.out.close()
        return len(self.lines)


def directory(file) -> dict[str, tuple[int, int, int]]:
    """Member name -> (place of its local header, stored size, method), from the central directory."""
    size = file.size()
    tail_size = min(size, 22 + NAME_LIMIT)
    tail = file.read_at(tail_size, size - tail_size)
    place = tail.rfind(END)
    while place >= 0 and (place + 22 > len(tail) or place + 22 + struct.unpack_from("<H", tail, place + 20)[0] != len(tail)):
        place = tail.rfind(END, 0, place)
    if place < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, place + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = file.read_at(20, size - tail_size + place - 20)
        if locator[:4] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    raw, at, members = file.read_at(length, start), 0, {}
    for _ in range(count):
        if raw[at:at + 4] != CENTRAL:
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, whole, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46:at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra, place = raw[at + 46 + name_size:at + 46 + name_size + extra_size], 0
        while place + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, place)
            if kind == 1:
                # 64-bit values stand for those fields only that are full, in this order.
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            place += 4 + n
        members[name] = (header, packed, 99 if flags & 1 else method)
        at += 46 + name_size + extra_size + note_size
    return members


def data_start(file, header: int) -> int:
    raw = file.read_at(30, header)
    if raw[:4] != LOCAL:
        raise ValueError("broken local header")
    return header + 30 + sum(struct.unpack_from("<HH", raw, 26))


def stored(file, members: dict, name: str) -> tuple[int, int]:
    """(first byte, size) of a stored member."""
    if name not in members:
        raise ValueError(f"the package has no {name}")
    header, size, method = members[name]
    if method != 0:
        raise ValueError(f"{name} is not stored plainly")
    return data_start(file, header), size


def locate(file) -> list[tuple[int, int]]:
    """(place in the file, length) of every record, by place."""
    members, found, archives = directory(file), [], {}
    indexes = [name for name in members if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj"))]
    if not indexes:
        raise ValueError("the package has no index")
    for name in indexes:
        start, size = stored(file, members, name)
        for line in file.read_at(size, start).splitlines():
            entry = json.loads(line[line.index(b"{"):])
            archive = entry["filename"]
            if archive not in archives:
                archives[archive] = stored(file, members, archive)
            found.append((archives[archive][0] + int(entry["offset"]), int(entry["length"])))
    return sorted(found)


def ranges(places: list[tuple[int, int]], most: int = 1 << 20) -> Iterator[list[tuple[int, int]]]:
    """Records that follow each other, about a megabyte at a time."""
    held: list[tuple[int, int]] = []
    for place, length in places:
        if held and (place != held[-1][0] + held[-1][1] or place + length - held[0][0] > most):
            yield held
            held = []
        held.append((place, length))
    if held:
        yield held


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, headers of the HTTP block, payload."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def revisits(pages: DataFrame) -> DataFrame:
    """revisit_id, revisit_digest, refers_to of the pages whose payload a page of a larger id has too.

    Narrow rows only; the largest id of a payload is pre-aggregated before it is moved.
    """
    rows = written(pages.select("page_id", "digest"), "page-digests")
    most = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return (
        rows.join(most, "digest").filter("page_id IS NULL OR page_id < refers_to").filter("refers_to IS NOT NULL")
        .select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to").distinct()
    )


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 0, max_bytes: int = 256 << 20,
) -> DataFrame:
    """Write one record per page; returns path and n_records of each package.

    Payloads below ``min_revisit_bytes`` are always responses.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.unhex(F.sha2(html, 256)).alias("digest"),
    )
    same = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest"))
    seen = revisits(rows.filter(F.octet_length("html") >= min_revisit_bytes))
    planned = rows.join(seen, same, "left").select(
        "page_id", "url", "html", F.col("revisit_digest").isNotNull().alias("revisit"), "refers_to",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, package, path = TaskContext.get().partitionId(), 0, None, ""
        made = []
        for rows in slices(batches):
            for page_id, url, text, revisit, refers_to in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if package is None:
                    path = f"{folder}/pages-{part:06d}-{number:04d}.zip"
                    package, number = Package(path), number + 1
                package.add(page_id, record(page_id, url, text.encode(), revisit, refers_to))
                if package.at >= max_bytes:
                    made.append({"path": path, "n_records": package.close()})
                    package = None
        if package is not None:
            made.append({"path": path, "n_records": package.close()})
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return written(planned.mapInArrow(run, "path string, n_records long"), "packages")


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record.

    A response's digest is checked against its payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = file_system(path)
                with fs.open_input_file(local) as file:
                    for held in ranges(locate(file)):
                        first = held[0][0]
                        chunk = file.read_at(held[-1][0] + held[-1][1] - first, first)
                        rows = []
                        for place, length in held:
                            fields, http, payload = parse(chunk[place - first:place - first + length])
                            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == RESPONSE and payload_digest(payload) != digest:
                                raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} differs from its digest")
                            rows.append((
                                page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest,
                                kind, page_of(fields.get("WARC-Refers-To")), *([payload] if with_payload else []),
                            ))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # A task per package: as many ranges as paths, and a stated count is not merged again.
    return packages.select("path").repartitionByRange(max(packages.count(), 1), "path").mapInArrow(run, schema + ", payload binary" * with_payload)
