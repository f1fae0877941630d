"""Bytes of the archive format, in pure Python: headers, index, directory, hash. No I/O and no Spark."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

from quillon import constants as c
from quillon.errors import ArchiveError

_LFH = struct.Struct("<IHHHHHIIIHH")
_CDH = struct.Struct("<IHHHHHHIIIHHHHHII")
_EOCD = struct.Struct("<IHHHHIIH")
_EOCD64 = struct.Struct("<IQHHIIQQQQ")
_LOCATOR64 = struct.Struct("<IIQI")
_INDEX_HEADER = struct.Struct("<4sHBI")


def fnv1a64(data: bytes, seed: int = c.FNV_BASIS) -> int:
    h = seed
    for b in data:
        h = (h ^ b) * c.FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def name_flags(name: bytes) -> int:
    """The UTF-8 flag where a name goes beyond ASCII."""
    return 0 if name.isascii() else c.FLAG_UTF8


def zip64_extra(*values: int) -> bytes:
    return struct.pack(f"<HH{len(values)}Q", c.EXTRA_ZIP64, 8 * len(values), *values) if values else b""


def hash_extra(digest: int = 0) -> bytes:
    return struct.pack("<HHQ", c.EXTRA_HASH, 8, digest)


def local_header(name: bytes, size: int, crc: int, extra: bytes = b"") -> bytes:
    """The header before a stored payload; payloads of 4 GiB - 1 and more have a ZIP64 field."""
    large = size >= c.SENTINEL32
    if large:
        extra = zip64_extra(size, size) + extra
    short = c.SENTINEL32 if large else size
    return _LFH.pack(c.SIG_LFH, 45 if large else 20, name_flags(name), 0, c.DOS_TIME, c.DOS_DATE, crc, short, short, len(name), len(extra)) + name + extra


def directory_record(name: bytes, size: int, crc: int, at: int, extra: bytes = b"") -> bytes:
    long_ = ([size, size] if size >= c.SENTINEL32 else []) + ([at] if at >= c.SENTINEL32 else [])
    extra = zip64_extra(*long_) + extra
    short, place = min(size, c.SENTINEL32), min(at, c.SENTINEL32)
    need = 45 if long_ else 20
    return _CDH.pack(c.SIG_CDH, need, need, name_flags(name), 0, c.DOS_TIME, c.DOS_DATE, crc, short, short, len(name), len(extra), 0, 0, 0, 0, place) + name + extra


def end_records(entries: int, size: int, at: int) -> bytes:
    """The end of the central directory, with ZIP64 records where a field needs them."""
    out = b""
    if entries >= c.SENTINEL16 or size >= c.SENTINEL32 or at >= c.SENTINEL32:
        out += _EOCD64.pack(c.SIG_EOCD64, c.EOCD64_FIXED - 12, 45, 45, 0, 0, entries, entries, size, at)
        out += _LOCATOR64.pack(c.SIG_LOCATOR64, 0, at + size, 1)
    n = min(entries, c.SENTINEL16)
    return out + _EOCD.pack(c.SIG_EOCD, 0, 0, n, n, min(size, c.SENTINEL32), min(at, c.SENTINEL32), 0)


def index_payload(profile: int, entries: list[tuple[str, int, int]]) -> bytes:
    """The five sections of an index of (name, offset, size)."""
    names = [name.encode() for name, _, _ in entries]
    for n in names:
        if not 0 < len(n) <= c.MAX_NAME:
            raise ArchiveError("INVALID_NAME", f"names have 1 to {c.MAX_NAME} bytes, not {len(n)}")
    head = _INDEX_HEADER.pack(c.MAGIC, c.VERSION, profile, len(entries))
    columns = [np.array([len(n) for n in names], "<u2"), np.array([o for _, o, _ in entries], "<u8"), np.array([s for _, _, s in entries], "<u8")]
    return b"".join([head, columns[0].tobytes(), *names, columns[1].tobytes(), columns[2].tobytes()])


@dataclass(frozen=True)
class Index:
    version: int
    profile: int
    entries: list[tuple[str, int, int]]

    def find(self, name: str) -> tuple[int, int] | None:
        return next(((o, s) for n, o, s in self.entries if n == name), None)


def parse_index(data: bytes, archive_size: int | None = None) -> Index:
    """Check and decode an index payload."""
    if len(data) < c.INDEX_HEADER:
        raise ArchiveError("TRUNCATED_INDEX", f"an index has {c.INDEX_HEADER} bytes at least, not {len(data)}")
    magic, version, profile, n = _INDEX_HEADER.unpack_from(data)
    if magic != c.MAGIC:
        raise ArchiveError("INVALID_MAGIC", f"magic is {magic!r}")
    if version > c.VERSION:
        raise ArchiveError("UNSUPPORTED_VERSION", f"version {version} is above {c.VERSION}")
    at = c.INDEX_HEADER + 2 * n
    if len(data) < at:
        raise ArchiveError("TRUNCATED_INDEX", f"{n} name lengths do not fit into {len(data)} bytes")
    lengths = np.frombuffer(data, "<u2", n, c.INDEX_HEADER).astype(np.int64)
    edges = at + np.concatenate([[0], np.cumsum(lengths)])
    if len(data) < edges[-1] + 16 * n:
        raise ArchiveError("TRUNCATED_INDEX", f"{n} entries do not fit into {len(data)} bytes")
    offsets = np.frombuffer(data, "<u8", n, int(edges[-1])).tolist()
    sizes = np.frombuffer(data, "<u8", n, int(edges[-1]) + 8 * n).tolist()
    names: list[str] = []
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        try:
            names.append(data[a:b].decode())
        except UnicodeDecodeError as e:
            raise ArchiveError("INVALID_NAME", f"an index name is not UTF-8: {e}") from None
        if not names[-1] or names[-1] == c.INDEX_NAME:
            raise ArchiveError("INVALID_NAME", f"{names[-1]!r} may not be in an index")
    if len(set(names)) < n:
        raise ArchiveError("DUPLICATE_NAME", f"{next(x for x in names if names.count(x) > 1)!r} is in the index twice")
    for name, o, s in zip(names, offsets, sizes, strict=True):
        if not s or o + s > min(1 << 64, 1 << 64 if archive_size is None else archive_size):
            raise ArchiveError("INVALID_OFFSET", f"{name!r} has bytes {o} to {o + s} of {archive_size}")
    return Index(version, profile, list(zip(names, offsets, sizes, strict=True)))


def parse_index_header(data: bytes) -> tuple[int, int]:
    """(size of the index payload, stored hash) from the first 51 bytes; checks all that the format says of them."""
    if len(data) < c.INDEX_LFH:
        raise ArchiveError("ARCHIVE_TOO_SMALL", f"{len(data)} bytes")
    sig, _, flags, method, _, _, _, csize, usize, n_name, n_extra = _LFH.unpack_from(data)
    name = data[c.LFH_FIXED : c.LFH_FIXED + 9]
    header, length, digest = struct.unpack_from("<HHQ", data, c.INDEX_LFH - c.INDEX_EXTRA)
    checks = {
        "signature": sig == c.SIG_LFH,
        "flags": not flags & (c.FLAG_ENCRYPTED | c.FLAG_DESCRIPTOR | c.FLAG_STRONG | c.FLAG_MASKED),
        "method": method == 0,
        "sizes": csize == usize and 0 < csize < c.SENTINEL32,
        "name length": n_name == len(c.INDEX_NAME),
        "extra length": n_extra == c.INDEX_EXTRA,
        "name": name == c.INDEX_NAME.encode(),
        "hash block": header == c.EXTRA_HASH and length == 8,
    }
    if wrong := [k for k, ok in checks.items() if not ok]:
        raise ArchiveError("INVALID_LFH", "first header: " + ", ".join(wrong))
    return csize, digest


def hash_ranges(index_size: int, archive_size: int) -> list[tuple[int, int]]:
    """Byte ranges under the integrity hash, ascending, overlaps once."""
    suffix = archive_size - c.HASH_WINDOW
    end = c.INDEX_LFH + index_size
    return [(c.INDEX_LFH, archive_size)] if end >= suffix else [(c.INDEX_LFH, end), (suffix, archive_size)]


@dataclass(frozen=True)
class DirectoryEntry:
    ord: int
    name: str
    flags: int
    method: int
    crc: int
    csize: int
    usize: int
    lfh_offset: int
    extra_len: int


@dataclass(frozen=True)
class End:
    entries: int
    size: int
    at: int
    comment: int


def parse_end(tail: bytes, archive_size: int) -> End:
    """The end record, ZIP64 values resolved, from the last bytes of an archive (without a comment the last 98)."""
    if len(tail) < c.EOCD_FIXED:
        raise ArchiveError("INVALID_ZIP_STRUCTURE", "no end of central directory")
    at = len(tail) - c.EOCD_FIXED
    while at >= 0 and struct.unpack_from("<I", tail, at)[0] != c.SIG_EOCD:
        at -= 1
    if at < 0:
        raise ArchiveError("INVALID_ZIP_STRUCTURE", "no end of central directory")
    _, disk, first, here, n, size, place, comment = _EOCD.unpack_from(tail, at)
    if disk or first or here != n:
        raise ArchiveError("INVALID_ZIP_STRUCTURE", "the archive has several segments")
    if c.SENTINEL16 in (n,) or c.SENTINEL32 in (size, place):
        p = at - c.LOCATOR64_FIXED
        q = p - c.EOCD64_FIXED
        if q < 0 or struct.unpack_from("<I", tail, p)[0] != c.SIG_LOCATOR64 or struct.unpack_from("<I", tail, q)[0] != c.SIG_EOCD64:
            raise ArchiveError("INVALID_ZIP64", "a sentinel without ZIP64 end records")
        _, _, _, _, _, _, _, n64, size64, place64 = _EOCD64.unpack_from(tail, q)
        n, size, place = n64, size64, place64
    if place + size > archive_size:
        raise ArchiveError("INVALID_OFFSET", "the central directory ends beyond the archive")
    return End(n, size, place, comment)


def zip64_values(extra: bytes, wanted: int) -> list[int]:
    """Values of the ZIP64 field of an extra block; as many as there are sentinels."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == c.EXTRA_ZIP64:
            if length < 8 * wanted or at + 4 + 8 * wanted > len(extra):
                break
            return list(struct.unpack_from(f"<{wanted}Q", extra, at + 4))
        at += 4 + length
    raise ArchiveError("INVALID_ZIP64", "a sentinel without a ZIP64 value")


def record_size(data: bytes, at: int, k: int) -> int:
    """Bytes of the directory record at a place."""
    if at + c.CDH_FIXED > len(data) or struct.unpack_from("<I", data, at)[0] != c.SIG_CDH:
        raise ArchiveError("INVALID_ZIP_STRUCTURE", f"directory record {k} is missing")
    return c.CDH_FIXED + sum(struct.unpack_from("<HHH", data, at + 28))


def parse_directory(data: bytes, entries: int, first: int = 0) -> Iterator[DirectoryEntry]:
    """Records in order; the first one has the number `first`."""
    at = 0
    for k in range(first, first + entries):
        if at + c.CDH_FIXED > len(data) or struct.unpack_from("<I", data, at)[0] != c.SIG_CDH:
            raise ArchiveError("INVALID_ZIP_STRUCTURE", f"directory record {k} is missing")
        _, _, _, flags, method, _, _, crc, csize, usize, n, e, m, _, _, _, place = _CDH.unpack_from(data, at)
        body = at + c.CDH_FIXED
        try:
            name = data[body : body + n].decode()
        except UnicodeDecodeError:
            name = data[body : body + n].decode("cp437")
        extra = data[body + n : body + n + e]
        if wanted := [v for v in (usize, csize, place) if v == c.SENTINEL32]:
            long_ = iter(zip64_values(extra, len(wanted)))
            usize, csize, place = (next(long_) if v == c.SENTINEL32 else v for v in (usize, csize, place))
        yield DirectoryEntry(k, name, flags, method, crc, csize, usize, place, e)
        at = body + n + e + m


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@cache
def _zeros(k: int) -> list[int]:
    """The operator on a CRC-32 that appends 2^k zero bytes: a value for each bit."""
    step = _zeros(k - 1) if k else [0xEDB88320, *(1 << j for j in range(31))]
    for _ in range(1 if k else 3):
        step = [_times(step, row) for row in step]
    return step


@cache
def _zeros_by_byte(k: int) -> list[list[int]]:
    """The same as a table for each byte of the CRC-32."""
    tables = []
    for first in range(0, 32, 8):
        table = [0]
        for row in _zeros(k)[first : first + 8]:
            table += [value ^ row for value in table]
        tables.append(table)
    return tables


def crc_combined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation from (crc, length) of its parts."""
    total = 0
    for crc, length in parts:
        k = 0
        while length and total:
            if length & 1:
                a, b, c_, d = _zeros_by_byte(k)
                total = a[total & 255] ^ b[total >> 8 & 255] ^ c_[total >> 16 & 255] ^ d[total >> 24]
            length >>= 1
            k += 1
        total ^= crc
    return total


def adler32(data: bytes, start: int = 1) -> int:
    return zlib.adler32(data, start)
