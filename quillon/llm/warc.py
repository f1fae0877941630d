r"""WARC archives: a writer and a splittable reader.

The writer makes one gzip member per record and rolls files at `FILE_BYTES`; files go to a shared folder and a table
of the files that tasks finished is kept, so what a lost task left behind is never read.  The reader cuts files into byte
ranges: a task looks for the gzip magic in its range, takes a candidate for a member if it decodes (checksum included) to a
record that opens with WARC/1, and owns the records that start inside its range, reading past the end for the last.

Payloads are UTF-8, null counting as empty.  Of equal payloads of at least `least_bytes`, those with the
smallest page_id are response records and the others revisit it; shorter ones are all responses.  So repeated rows of
the smallest page_id are all responses; null page_ids come after all others, and if a payload has no other, all its
rows are responses.  A null url is written as the record's own id; control characters of urls are percent-encoded.  Empty tables give
empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.frames import forget, keep, shared_dir, shuffle_width

FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
OPENING = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def file_system(uri: str):
    """(file system, path) of a URI in any store that pyarrow knows; viewing a plain path as local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def page_urn(page_id: int | None) -> str:
    return URN + ("none" if page_id is None else str(page_id))


def from_urn(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<?{URN}(-?\d+)>?", urn or "")
    return int(found[1]) if found else None


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_pieces(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> list[bytes]:
    """The parts of one record; with refers_to a revisit, which leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = [http] if revisit else [http, payload]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{page_urn(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url) if url else page_urn(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{page_urn(refers_to)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {sum(map(len, block))}",
    ]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", *block, b"\r\n\r\n"]


def record(*of) -> bytes:
    return b"".join(record_pieces(*of))


def member_pieces(pieces: list[bytes], level: int = 6) -> Iterator[bytes]:
    """One gzip member, made piece by piece."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    for piece in pieces:
        yield z.compress(piece)
    yield z.flush()


def member(data: bytes, level: int = 6) -> bytes:
    return b"".join(member_pieces([data], level))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, html as archives. Returns the written table of files: file, size, records."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/quillon/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    twice = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = keep(twice.where("n > 1 and first is not null").select("sha", "first"), "payloads")
    rows = rows.join(twice, "sha", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, payload, sha, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha", "first")), strict=True):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                for z in member_pieces(record_pieces(page.as_py(), url.as_py(), payload.as_py(), digest, first.as_py())):
                    out.write(z)
                    size += len(z)
                n += 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{c}" for c in cols[0]], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "size", "records"])

    files = keep(rows.mapInArrow(run, "file string, size long, records long"), "warc-files")
    forget(twice)
    return files


class Members:
    """Gzip members of a file that start in [start, end) and decode to WARC records. Of the file a chunk is held at a time."""

    def __init__(self, source, size: int, start: int, end: int):
        self.source, self.size, self.start, self.end = source, size, start, end
        self.base, self.data = start, b""

    def _have(self, place: int) -> bool:
        """Hold the bytes at a place; false at the end of the file."""
        if not self.base <= place < self.base + len(self.data):
            self.source.seek(place)
            self.base, self.data = place, self.source.read(max(0, min(CHUNK, self.size - place)))
        return len(self.data) > 0

    def _decoded(self, place: int) -> tuple[bytes, int] | None:
        """The record at a place and the place after its member; None if there is no such member."""
        z, at, step = zlib.decompressobj(31), place, 4096
        parts: list[bytes] = []
        told = b""
        while not z.eof:
            if not self._have(at):
                return None
            piece = self.data[at - self.base : at - self.base + step]
            try:
                parts.append(z.decompress(piece))
            except zlib.error:
                return None
            at, step = at + len(piece), min(2 * step, 65536)
            if len(told) < len(OPENING):
                told = (told + parts[-1])[: len(OPENING)]
                if not OPENING.startswith(told):
                    return None
        return (b"".join(parts), at - len(z.unused_data)) if told == OPENING else None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        place = self.start
        while place < self.end and self._have(place):
            found = self.data.find(MAGIC, place - self.base)
            if found < 0:
                have = self.base + len(self.data)
                if have >= self.size:
                    return
                place = max(place + 1, have - len(MAGIC) + 1)
                if place + len(MAGIC) > have:  # the magic may go on behind the chunk
                    self.base, self.data = place, b""
                continue
            place = self.base + found
            if place >= self.end:
                return
            got = self._decoded(place)
            if got:
                yield place, got[0]
            place = got[1] if got else place + 1


def parsed(raw: bytes) -> tuple[dict[str, str], memoryview]:
    """Headers (names in lower case) and block."""
    at = raw.find(b"\r\n\r\n")
    at = len(raw) if at < 0 else at
    lines = raw[:at].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = memoryview(raw)[at + 4 :]
    return headers, block[: int(headers.get("content-length", len(block)))]


def http_parts(block: memoryview) -> tuple[bytes, memoryview]:
    """Header lines and payload of an HTTP message."""
    head = bytes(block[:CHUNK])
    at = head.find(b"\r\n\r\n")
    if at < 0 and len(block) > CHUNK:
        head = bytes(block)
        at = head.find(b"\r\n\r\n")
    return (head, block[len(block) :]) if at < 0 else (head[:at], block[at + 4 :])


RECORDS = "file string, place long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Response and revisit records of a table of files (file, size). Digests of responses are computed, and must agree with their headers."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("size > 0").select("file", "size", F.explode(starts).alias("start"))
    ranges = ranges.repartition(shuffle_width(spark), "file", "start")

    def rows(file: str, size: int, start: int) -> Iterator[tuple]:
        store, path = file_system(file)
        with store.open_input_file(path) as source:
            for place, raw in Members(source, size, start, min(size, start + range_bytes)):
                h, block = parsed(raw)
                kind = h.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                http, payload = http_parts(block)
                told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                if kind == "response":
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest and own != digest:
                        raise ValueError(f"{file}, record at {place}: payload digest {own}, header {digest}")
                    digest, n = own, len(payload)
                else:
                    n = int(told[1]) if told else None
                yield file, place, kind, from_urn(h.get("warc-record-id")), h.get("warc-target-uri"), digest, n, from_urn(h.get("warc-refers-to")), bytes(payload) if payloads and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for file, whole, start in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start")), strict=True):
                for r in rows(file, whole, start):
                    held.append(r)
                    size += len(r[-1] or b"") + 200
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(run, RECORDS)
