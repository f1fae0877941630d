"""Byte ranges of local files, HTTP objects and any store that pyarrow knows."""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import codec
from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.functions.expressions import is_url
from quillon.sources.store import resolved

#: Bytes that are copied at a time.
SLICE = 8 << 20
AGENT = "Mozilla/5.0"


class Source:
    """An object that gives its size and byte ranges. Counts its requests."""

    def __init__(self, path: str):
        self.path = path
        self.requests = 0
        self._size: int | None = None
        self._file = None

    def _http(self, headers: dict[str, str], method: str = "GET"):
        request = urllib.request.Request(self.path, headers={"User-Agent": AGENT} | headers, method=method)
        return urllib.request.urlopen(request, timeout=60)

    @property
    def size(self) -> int:
        if self._size is None:
            if is_url(self.path):
                with self._http({}, "HEAD") as r:
                    self._size = int(r.headers["Content-Length"])
            else:
                store, path = resolved(self.path)
                found = store.get_file_info(path)
                if found.size is None:
                    raise FileNotFoundError(self.path)
                self._size = found.size
        return self._size

    def get(self, offset: int, size: int, short: bool = False) -> bytes:
        """Bytes offset.. of the object. Fewer than asked for are an error, unless short is allowed (then at the end of the object)."""
        self.requests += 1
        if is_url(self.path):
            try:
                with self._http({"Range": f"bytes={offset}-{offset + size - 1}"}) as r:
                    if r.status == 200:  # a server without ranges: skip what was not asked for
                        left = offset
                        while left and (skipped := r.read(min(left, 1 << 20))):
                            left -= len(skipped)
                        self._size = int(r.headers["Content-Length"]) if r.headers.get("Content-Length") else self._size
                    else:
                        told = r.headers.get("Content-Range", "").rpartition("/")[2]
                        self._size = int(told) if told.isdigit() else self._size
                    data = r.read(size)
            except urllib.error.HTTPError as e:
                if e.code != 416:
                    raise
                data = b""
        else:
            if self._file is None:
                store, path = resolved(self.path)
                self._file = store.open_input_file(path)
                self._size = self._file.size()
            self._file.seek(min(offset, self._size))
            data = self._file.read(size)
        if len(data) < size and not short:
            raise OSError(f"{self.path}: {len(data)} of {size} bytes at {offset}")
        return data

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None

    def all(self) -> bytes:
        return self.get(0, self.size)


class Bytes:
    """Bytes at hand, read like a source."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def get(self, offset: int, size: int, short: bool = False) -> bytes:
        if offset + size > self.size and not short:
            raise OSError(f"{max(0, self.size - offset)} of {size} bytes at {offset}")
        return self.data[offset : offset + size]


def bootstrap(source: Source, verify: bool = False) -> codec.Index:
    """The index of an archive: one speculative read, a second one only for a longer index; small archives are read whole.

    verify: also check the archive's size and integrity hash.
    """
    head = source.get(0, c.BOOTSTRAP, short=True)
    size, digest = codec.parse_index_header(head)
    end = c.INDEX_LFH + size
    if len(head) < c.BOOTSTRAP and end > len(head):
        raise ArchiveError("TRUNCATED_INDEX", f"the index ends at {end}, the archive at {len(head)}")
    payload = head[c.INDEX_LFH : end] if end <= len(head) else head[c.INDEX_LFH :] + source.get(len(head), end - len(head))
    index = codec.parse_index(payload, source.size if verify else None)
    if verify:
        whole = source.size
        if whole < c.LEAST_ARCHIVE:
            raise ArchiveError("ARCHIVE_TOO_SMALL", f"{whole} bytes of {c.LEAST_ARCHIVE} at least")
        found = archive_hash(source, size)
        if found != digest:
            raise ArchiveError("HASH_MISMATCH", f"computed {found:#018x}, stored {digest:#018x}")
    return index


def archive_hash(source: Source | Bytes, index_size: int) -> int:
    h = c.FNV_BASIS
    for a, b in codec.hash_ranges(index_size, source.size):
        h = codec.fnv1a64(source.get(a, b - a), h)
    return h


def directory(source: Source) -> tuple[codec.End, list[codec.DirectoryEntry]]:
    tail_size = min(source.size, c.EOCD_FIXED + c.LOCATOR64_FIXED + c.EOCD64_FIXED)
    end = codec.parse_end(source.get(source.size - tail_size, tail_size), source.size)
    return end, list(codec.parse_directory(source.get(end.at, end.size) if end.size else b"", end.entries))


def directory_parts(source: Source, records: int) -> list[tuple[int, int, int, int]]:
    """(first record, end record, first byte, end byte) of parts of the directory: one pass over its fixed fields, a piece at a time."""
    tail_size = min(source.size, c.EOCD_FIXED + c.LOCATOR64_FIXED + c.EOCD64_FIXED)
    end = codec.parse_end(source.get(source.size - tail_size, tail_size), source.size)
    starts: list[tuple[int, int]] = []
    at, data, base = end.at, b"", end.at
    for k in range(end.entries):
        if at + c.CDH_FIXED > base + len(data):
            base, data = at, source.get(at, min(SLICE, end.at + end.size - at))
        if k % records == 0:
            starts.append((k, at))
        at += codec.record_size(data, at - base, k)
    starts.append((end.entries, at))
    return [(a, b, x, y) for (a, x), (b, y) in zip(starts, starts[1:], strict=False)]


def payload_offsets(source: Source, entries: list[codec.DirectoryEntry], gap: int = 1 << 16, most: int = SLICE) -> Iterator[tuple[codec.DirectoryEntry, int]]:
    """Where payloads begin, by their local headers, in order of place; headers that lie near each other are read by one request."""
    ordered = sorted(entries, key=lambda e: e.lfh_offset)
    i = 0
    while i < len(ordered):
        start, j = ordered[i].lfh_offset, i + 1
        while j < len(ordered) and ordered[j].lfh_offset - ordered[j - 1].lfh_offset <= gap and ordered[j].lfh_offset + c.LFH_FIXED - start <= most:
            j += 1
        data = source.get(start, ordered[j - 1].lfh_offset + c.LFH_FIXED - start)
        for e in ordered[i:j]:
            at = e.lfh_offset - start
            yield e, e.lfh_offset + c.LFH_FIXED + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
        i = j


def payload_offset(source: Source, lfh_offset: int) -> int:
    head = source.get(lfh_offset, c.LFH_FIXED)
    return lfh_offset + c.LFH_FIXED + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def cached_slice(source: Source, offset: int, size: int, folder: str) -> str:
    """An embedded payload as a file of its own in a folder that all machines share, named by its content; unchanged bytes, copied in pieces."""
    store, place = resolved(folder)
    store.create_dir(place, recursive=True)
    own, digest = f"{place}/{uuid.uuid4().hex}.part", hashlib.sha256()
    with store.open_output_stream(own, compression=None) as out:
        for at in range(offset, offset + size, SLICE):
            data = source.get(at, min(SLICE, offset + size - at))
            digest.update(data)
            out.write(data)
    name = digest.hexdigest() + ".parquet"
    store.move(own, f"{place}/{name}")
    return f"{folder if '://' in folder else 'file://' + place}/{name}"


def with_payloads(entries: DataFrame, source: str | F.Column, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Adds payload, the bytes of (offset, size); rows are dealt by archive and region, and neighbours are read by one request.

    source: the archive, or a column of archives. A group of neighbours spans about `most` bytes at a time.
    """
    rows = entries.withColumn("_source", F.lit(source) if isinstance(source, str) else source)
    rows = rows.repartition(F.col("_source"), F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("_source", "offset")
    names = entries.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: Source | None = None  # rows are sorted by archive
        for batch in batches:
            paths, offsets, sizes = (batch.column(x).to_pylist() for x in ("_source", "offset", "size"))
            offsets, sizes = [int(x) for x in offsets], [int(x) for x in sizes]
            i = 0
            while i < len(paths):
                j, end = i + 1, offsets[i] + sizes[i]
                while j < len(paths) and paths[j] == paths[i] and offsets[j] <= end + gap and max(end, offsets[j] + sizes[j]) - offsets[i] <= most:
                    end = max(end, offsets[j] + sizes[j])
                    j += 1
                if opened is None or opened.path != paths[i]:
                    if opened is not None:
                        opened.close()
                    opened = Source(paths[i])
                data = opened.get(offsets[i], end - offsets[i])
                payloads = [data[o - offsets[i] : o - offsets[i] + s] for o, s in zip(offsets[i:j], sizes[i:j], strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(payloads, pa.binary())], names=[*names, "payload"])
                i = j
        if opened is not None:
            opened.close()

    return rows.mapInArrow(run, schema)


def exists(path: str) -> bool:
    try:
        return Source(path).size >= 0
    except (OSError, FileNotFoundError):
        return False
