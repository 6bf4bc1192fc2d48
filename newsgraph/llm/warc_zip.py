"""WARC records in ZIP packages: a streaming writer, and a reader that never extracts.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdx`` (place of each
record), both stored without compression, so a record is one range of the package file.
"""

from __future__ import annotations

import base64
import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from math import ceil

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import map_arrow
from newsgraph.session import scratch_dir, stored

MIN_BYTES = 0  # production parameter: payloads from this size on are written once
PACKAGE_BYTES = 64 << 20  # a task starts a new package beyond this size
PIECE = 8 << 20  # bytes of neighbouring records that go to one reading task together
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_LIMIT = 0xFFFFFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


class Package:
    """Writes stored members one after the other to a stream; sizes follow the data, so nothing is held back."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        size = _LIMIT if self.zip64 else 0
        self.entry = [raw, self.at, 0, 0]  # name, place, check sum, size
        version = 45 if self.zip64 else 20
        self._write(struct.pack("<4s5H3I2H", b"PK\3\4", version, 0x0808, 0, 0, 0x21, 0, size, size, len(raw), len(extra)))
        self._write(raw + extra)

    def add(self, data: bytes) -> tuple[int, int]:
        """Append to the open member; returns the place inside the member and the length."""
        place = self.entry[3]
        self._write(data)
        self.entry[2] = zlib.crc32(data, self.entry[2])
        self.entry[3] += len(data)
        return place, len(data)

    def end(self) -> None:
        _, _, check, size = self.entry
        self._write(struct.pack("<4sIQQ" if self.zip64 else "<4sIII", b"PK\7\x08", check, size, size))
        self.entries.append(self.entry)

    def close(self) -> None:
        start = self.at
        for raw, place, check, size in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if self.zip64 else b""
            if self.zip64:
                size = place = _LIMIT
            version = 45 if self.zip64 else 20
            head = (b"PK\1\2", version, version, 0x0808, 0, 0, 0x21, check, size, size, len(raw), len(extra))
            self._write(struct.pack("<4s6H3I5H2I", *head, 0, 0, 0, 0, place) + raw + extra)
        size, n, end = self.at - start, len(self.entries), self.at
        if self.zip64:
            self._write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, size, start = 0xFFFF, _LIMIT, _LIMIT
        self._write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, size, start, 0))


def members(file) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of the stored members of a package, from its central directory."""
    size = file.size()
    tail_at = max(0, size - 65557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6")
    # The signature may also occur in the comment; the comment's length must fit the end of the file.
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP package")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
        record = file.read_at(56, struct.unpack_from("<Q", tail, locator + 8)[0])
        n, length, start = struct.unpack_from("<3Q", record, 32)
    directory = file.read_at(length, start)
    out, at = {}, 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<2I3H", directory, at + 20)
        place = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # the 64-bit values of the fields that are full, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == _LIMIT else plain
                packed = wide.pop(0) if packed == _LIMIT else packed
                place = wide.pop(0) if place == _LIMIT else place
            extra = extra[4 + width :]
        if method == 0:
            n_name_here, n_extra_here = struct.unpack_from("<2H", file.read_at(30, place), 26)
            out[name] = (place + 30 + n_name_here + n_extra_here, packed)
        at += 46 + n_name + n_extra + n_note
    return out


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the length of the payload, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""

    def fields(head: bytes) -> dict[str, str]:
        pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        return {k.lower(): v for k, v in pairs}

    head, rest = data.split(b"\r\n\r\n", 1)
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def write_packages(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, zip64: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ZIP packages in ``folder``; returns the stored list of packages.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response and the others are
    revisits. A repeated task writes packages under new names and only those of the attempt that succeeded are
    listed, so a lost executor leaves at most unlisted files.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("_sha1", F.sha1("payload")).withColumn("_sha2", F.sha2("payload", 256))
    first = rows.groupBy("_sha1", "_sha2").agg(F.min("page_id").alias("_first"))
    known = rows.join(first, ["_sha1", "_sha2"])
    revisit = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    known = known.select("page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        package, index, path = None, [], ""

        def finish() -> pa.RecordBatch:
            package.end()
            package.begin(INDEX)
            package.add("".join(index).encode())
            package.end()
            package.close()
            package.out.close()
            return pa.record_batch([pa.array([path]), pa.array([len(index)], pa.int64())], ["path", "records"])

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if package is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    package = Package(system.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}"), zip64)
                    index = []
                    package.begin(DATA)
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                place, length = package.add(gzip.compress(data, 6, mtime=0))
                index.append(f"{place} {length}\n")
                if package.at >= PACKAGE_BYTES:
                    yield finish()
                    package = None
        if package is not None:
            yield finish()

    return stored(map_arrow(known, write, "path string, records long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    The indexes give the ranges; neighbours of PIECE bytes are dealt out together and each record is one read of its
    package.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = filesystem(path)
                with system.open_input_file(name) as file:
                    found = members(file)
                    start, length = found[INDEX]
                    lines = [line.split() for line in file.read_at(length, start).splitlines()]
                places = [found[DATA][0] + int(a) for a, _ in lines]
                yield pa.record_batch(
                    [pa.array([path] * len(lines)), pa.array(places, pa.int64()), pa.array([int(b) for _, b in lines], pa.int64())],
                    ["path", "place", "length"],
                )

    def page(name: str | None) -> int | None:
        number = name.removeprefix("<urn:page:").removesuffix(">") if name else ""
        return int(number) if number else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        path, file = None, None
        for batch in batches:
            out, held = [], 0
            for own, place, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != path:
                    if file is not None:
                        file.close()
                    system, name = filesystem(own)
                    path, file = own, system.open_input_file(name)
                warc, http, payload = parse(gzip.decompress(file.read_at(length, place)))
                kind = warc["warc-type"]
                same = kind == "revisit"
                found = warc["warc-payload-digest"].removeprefix("sha1:") if same else digest(payload)
                size = int(http["content-length"]) if same else len(payload)
                own_payload = None if same else payload
                refers_to = page(warc.get("warc-refers-to"))
                out.append((page(warc["warc-record-id"]), warc.get("warc-target-uri"), own_payload, size, found, kind, refers_to))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if file is not None:
            file.close()

    parallel = 4 * packages.sparkSession.sparkContext.defaultParallelism
    n = packages.count()
    paths = packages.select("path").repartition(max(1, min(n, parallel), n // 64), "path")
    places = map_arrow(paths, ranges, "path string, place long, length long")
    # Tasks by bytes of the records, not of the places, which adaptive execution would merge into a few partitions.
    places = stored(places, "places")
    piece = F.floor(F.col("place") / PIECE)
    total, pieces = places.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("path", piece)).first()
    places = places.repartition(max(1, min(pieces, parallel), ceil(total / (8 * PIECE))), "path", piece)
    places = places.sortWithinPartitions("path", "place")
    return map_arrow(
        places,
        read,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long",
    )


def archive_digest(pages: DataFrame, min_bytes: int = MIN_BYTES, zip64: bool = False) -> DataFrame:
    """Write all pages to packages in the shared folder, read the packages back, one row per page.

    Defined results: NULL html is an empty payload. Rows that repeat the smallest page_id of a payload are all
    responses. A NULL page_id is a revisit if another page has the payload and a response otherwise. Empty input: no
    rows. Columns other than page_id, url and html are not used.
    """
    folder = scratch_dir(pages.sparkSession, "warc")
    packages = write_packages(pages, folder, min_bytes, zip64)
    return read_packages(packages).drop("url", "payload")
