"""Column builders: names, paths, sizes, little-endian bytes, hashes, times. All are JVM-side expressions."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon import constants as c


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_length(x: Column | str) -> Column:
    return F.octet_length(_col(x)).cast("long")


def lfh_size(name: Column | str, size: Column | str) -> Column:
    """Bytes of a local header: payloads of 4 GiB - 1 and more have a ZIP64 field."""
    return F.lit(c.LFH_FIXED) + byte_length(name) + F.when(_col(size) >= c.SENTINEL32, c.ZIP64_LFH_EXTRA).otherwise(0)


# Paths -------------------------------------------------------------------------------------------------------------


def is_url(source: str) -> bool:
    return source.startswith(("http://", "https://"))


#: How the virtual file system calls stores.
STORES = {"s3": "vsis3", "gs": "vsigs", "az": "vsiaz", "hdfs": "vsihdfs"}


def vsi_base(source: str) -> str:
    """What a virtual path appends for an archive: remote ones by their store, local ones absolute."""
    if is_url(source):
        return f"/vsicurl/{source}"
    scheme, _, rest = source.partition("://")
    if rest and scheme in STORES:
        return f"/{STORES[scheme]}/{rest}"
    return os.path.abspath(rest if rest and scheme == "file" else source)


def vsi_base_dir(source: str) -> str:
    """The same for the folder of a catalog, with a slash at the end."""
    return posixpath.dirname(vsi_base(source)).rstrip("/") + "/"


def vsi_store(url: Column | str) -> Column:
    """The virtual path of an object by its scheme; other paths as they are."""
    u = _col(url)
    out = F.when(u.rlike("^https?://"), F.concat(F.lit("/vsicurl/"), u))
    for scheme, prefix in STORES.items():
        out = out.when(u.startswith(f"{scheme}://"), F.concat(F.lit(f"/{prefix}/"), F.substr(u, F.lit(len(scheme) + 4))))
    return out.otherwise(u)


def vsi_path(offset: Column | str, size: Column | str, base: Column) -> Column:
    """The byte range of an entry as a virtual path: /vsisubfile/{offset}_{size},{base}."""
    return F.concat(F.lit("/vsisubfile/"), _col(offset).cast("string"), F.lit("_"), _col(size).cast("string"), F.lit(","), base)


def level_file(path: Column | str) -> Column:
    """A level's path to its table: sample/before becomes sample__before.parquet."""
    return F.concat(F.replace(_col(path), F.lit("/"), F.lit("__")), F.lit(".parquet"))


def data_path(index: Column | str, leaf: Column | str) -> Column:
    return F.concat(F.lit("DATA/"), _col(index).cast("string"), F.lit("/"), _col(leaf))


# Names -------------------------------------------------------------------------------------------------------------


def clean_name(raw: Column | str) -> Column:
    """A name that an archive may hold: no NULs, backslashes, drive letters, leading slashes, empty, "." or ".." parts."""
    x = F.coalesce(_col(raw), F.lit(""))
    x = F.trim(F.translate(F.replace(x, F.lit("\\"), F.lit("/")), "\x00", ""))
    x = F.regexp_replace(F.regexp_replace(x, "^[A-Za-z]:+", ""), "^/+", "")
    parts = F.filter(F.transform(F.split(x, "/"), lambda p: F.trim(p)), lambda p: ~p.isin("", ".", ".."))
    x = F.array_join(parts, "/")
    x = F.when(x == "", F.lit("payload.bin")).otherwise(x)
    return F.when(x.isin(c.INDEX_NAME, c.PADDING_NAME), F.concat(F.lit("payload/"), x, F.lit(".bin"))).otherwise(x)


def download_name(raw: Column | str, default: str = "dataset.zip") -> Column:
    asked = F.trim(F.coalesce(_col(raw), F.lit("")))
    return F.replace(clean_name(F.when(asked == "", F.lit(default)).otherwise(asked)), F.lit("/"), F.lit("-"))


def suffixed(name: Column | str, n: Column | str) -> Column:
    """name with -n before the extension of its last part."""
    x, k = _col(name), _col(n).cast("string")
    leaf = F.substring_index(x, "/", -1)
    head = F.substr(x, F.lit(1), F.char_length(x) - F.char_length(leaf))
    dot = F.char_length(leaf) - F.char_length(F.substring_index(leaf, ".", -1))  # chars up to the last dot, that one included
    stem, ext = F.substr(leaf, F.lit(1), dot - 1), F.substr(leaf, dot)
    return F.when(leaf.contains(".") & (dot > 1), F.concat(head, stem, F.lit("-"), k, ext)).otherwise(F.concat(x, F.lit("-"), k))


def name_fault(name: Column | str) -> Column:
    """Which rule a name breaks; null if none."""
    x = _col(name)
    return (
        F.when(x.isNull() | (x == ""), "empty")
        .when(byte_length(x) > c.MAX_NAME, "too long")
        .when(x.startswith("/"), "leading slash")
        .when(x.rlike("^[A-Za-z]:"), "drive letter")
        .when(x.contains("\\"), "backslash")
        .when(x.rlike(r"(^|/)\.\.?(/|$)"), "dot component")
        .when(x.isin(*c.RESERVED_NAMES), "reserved")
    )


def encoding_guess(raw: Column | str) -> Column:
    """Of a name's bytes: ascii, utf-8, or cp437 for what is neither."""
    x = _col(raw)
    text = x.cast("string")
    return F.when(F.hex(x).rlike("^([0-7].)*$"), "ascii").when(F.is_valid_utf8(text), "utf-8").otherwise("cp437")


#: What bytes above 127 stand for in the code page of old archives.
_CP437 = bytes(range(128, 256)).decode("cp437")


def cp437_text(raw: Column | str) -> Column:
    """Bytes in code page 437 as a string."""
    return F.translate(F.decode(_col(raw), "ISO-8859-1"), "".join(map(chr, range(128, 256))), _CP437)


def decoded_name(raw: Column | str) -> Column:
    """A name's bytes as a string, by their guessed encoding."""
    return F.when(encoding_guess(raw) == "cp437", cp437_text(raw)).otherwise(_col(raw).cast("string"))


def sql_literal(text: Column | str) -> Column:
    """A string as an SQL literal."""
    return F.concat(F.lit("'"), F.replace(_col(text), F.lit("'"), F.lit("''")), F.lit("'"))


def range_map(name: Column | str, offset: Column | str, size: Column | str) -> Column:
    """An aggregate: the map of names to (offset, size) of an index, which is small."""
    return F.map_from_entries(F.collect_list(F.struct(_col(name), F.struct(_col(offset).alias("offset"), _col(size).alias("size")))))


def zipped(names: Column | str, offsets: Column | str, sizes: Column | str) -> Column:
    """Three arrays as rows (ord, name, offset, size)."""
    entries = F.transform(F.arrays_zip(_col(names).alias("name"), _col(offsets).alias("offset"), _col(sizes).alias("size")), lambda e, k: F.struct(k.alias("ord"), e["name"].alias("name"), e["offset"].alias("offset"), e["size"].alias("size")))
    return F.inline(entries)


def pattern_bytes(seed: Column | str, n: Column | str) -> Column:
    """n bytes of v = 33 v + i + seed modulo 256, from v = seed."""
    s, count = _col(seed).cast("long"), _col(n)
    places = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda a, i: F.struct((a["v"] * 33 + i + s).bitwiseAND(F.lit(255)).alias("v"), F.concat(a["out"], F.array((a["v"] * 33 + i + s).bitwiseAND(F.lit(255)))).alias("out"))
    start = F.struct(s.bitwiseAND(F.lit(255)).alias("v"), F.array().cast("array<bigint>").alias("out"))
    return F.unhex(F.aggregate(places, start, step, lambda a: F.array_join(F.transform(a["out"], lambda v: F.lpad(F.hex(v), 2, "0")), "")))


def padding_bytes(n: Column | str) -> Column:
    return F.unhex(F.repeat(F.lit(f"{c.PADDING_BYTE:02X}"), _col(n).cast("int")))


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def leaf_pattern(glob: str) -> tuple[str, int, int]:
    """(regular expression, least, most) of a variable leaf such as img*[4,16].tif; a fixed leaf counts once."""
    import re

    found = re.fullmatch(r"(.*)\*\[(\d+),(\d+)\](.*)", glob)
    if not found:
        return f"^{re.escape(glob)}$", 1, 1
    return f"^{re.escape(found[1])}[^/]*{re.escape(found[4])}$", int(found[2]), int(found[3])


# Numbers and bytes -------------------------------------------------------------------------------------------------


def le_hex(value: Column | str, size: int) -> Column:
    """Little-endian bytes of a non-negative long, in upper-case hex."""
    v = _col(value).cast("long")
    return F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)))


def le_bytes(value: Column | str, size: int) -> Column:
    return F.unhex(le_hex(value, size))


def le_value(data: Column | str, at: Column | int, size: int) -> Column:
    """The little-endian number in bytes at.. of a binary (at from 0): a long, or for 8 bytes a decimal(20,0)."""
    d, at = _col(data), F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.conv(F.hex(F.substr(d, at + i + 1, F.lit(1))), 16, 10).cast("decimal(20,0)")
    out = byte(0)
    for i in range(1, size):
        out = (out + byte(i) * F.lit(256**i).cast("decimal(20,0)")).cast("decimal(20,0)")
    return out if size == 8 else out.cast("long")


def hex64(value: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(_col(value)), 16, "0")))


def fnv1a64(text: Column | str) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes as 16 hex digits, in two 32-bit limbs (for short inputs)."""
    s = F.encode(_col(text), "utf-8")
    low32 = F.lit(0xFFFFFFFF)
    n = F.octet_length(s)
    values = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.hex(F.substr(s, i, F.lit(1))), 16, 10).cast("bigint"))
    )

    def step(h: Column, b: Column) -> Column:
        # The prime is 2^40 + 0x1B3: the low limb times 2^8 goes to the high one.
        x = h["lo"].bitwiseXOR(b)
        small = x * F.lit(0x1B3)
        high = (x * F.lit(256)).bitwiseAND(low32) + (h["hi"] * F.lit(0x1B3)).bitwiseAND(low32) + F.shiftright(small, 32)
        return F.struct(high.bitwiseAND(low32).alias("hi"), small.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(c.FNV_BASIS >> 32).cast("bigint").alias("hi"), F.lit(c.FNV_BASIS & 0xFFFFFFFF).cast("bigint").alias("lo"))
    return F.aggregate(values, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def human_bytes(n: Column | str) -> Column:
    """Bytes as B, KiB, MiB or GiB: one decimal from ten on, else two."""
    v = _col(n).cast("double")
    out = F.when(v < 1024, F.concat(_col(n).cast("string"), F.lit(" B")))
    for k, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        x = v / 1024**k
        said = F.when(x >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
        said = F.concat(said, F.lit(f" {unit}"))
        out = out.when(v < 1024 ** (k + 1), said) if k < 3 else out.otherwise(said)
    return out


def dos_date(ts: Column | str) -> Column:
    t = _col(ts)
    return (F.year(t) - 1980) * 512 + F.month(t) * 32 + F.dayofmonth(t)


def dos_time(ts: Column | str) -> Column:
    t = _col(ts)
    return F.hour(t) * 2048 + F.minute(t) * 32 + F.floor(F.second(t) / 2).cast("int")


def from_dos(date: Column | str, time: Column | str) -> Column:
    d, t = _col(date), _col(time)
    field = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(F.lit(mask))
    return F.make_timestamp(field(d, 9, 127) + 1980, field(d, 5, 15), field(d, 0, 31), field(t, 11, 31), field(t, 5, 63), F.shiftleft(field(t, 0, 31), 1))


def named(code: Column | str, names: dict[int, str], other: str = "UNKNOWN") -> Column:
    """The name of a code."""
    x = _col(code)
    out = F.lit(other)
    for k, name in names.items():
        out = F.when(x == k, name).otherwise(out)
    return out


def status_name(code: Column | str) -> Column:
    return named(code, c.STATUSES)


def profile_name(code: Column | str) -> Column:
    return named(code, c.PROFILES, "reserved")


def local_header_hex(name: Column | str, size: Column | str, crc: Column | str | None = None) -> Column:
    """The local header of a stored entry below 4 GiB - 1 in upper-case hex; without a crc as many zeros."""
    x = _col(name)
    flags = F.when(F.octet_length(x) != F.char_length(x), F.lit(c.FLAG_UTF8)).otherwise(F.lit(0))
    head = [(F.lit(c.SIG_LFH), 4), (F.lit(20), 2), (flags, 2), (F.lit(0), 2), (F.lit(c.DOS_TIME), 2), (F.lit(c.DOS_DATE), 2), (F.lit(0) if crc is None else _col(crc), 4), (_col(size), 4), (_col(size), 4), (byte_length(x), 2), (F.lit(0), 2)]
    return F.concat(*(le_hex(v, n) for v, n in head), F.hex(F.encode(x, "utf-8")))


def directory_record_hex(name: Column | str, size: Column | str, at: Column | str, crc: Column | str | None = None) -> Column:
    x = _col(name)
    flags = F.when(F.octet_length(x) != F.char_length(x), F.lit(c.FLAG_UTF8)).otherwise(F.lit(0))
    head = [(F.lit(c.SIG_CDH), 4), (F.lit(20), 2), (F.lit(20), 2), (flags, 2), (F.lit(0), 2), (F.lit(c.DOS_TIME), 2), (F.lit(c.DOS_DATE), 2), (F.lit(0) if crc is None else _col(crc), 4), (_col(size), 4), (_col(size), 4), (byte_length(x), 2)]
    head += [(F.lit(0), 2)] * 4 + [(F.lit(0), 4), (_col(at), 4)]
    return F.concat(*(le_hex(v, n) for v, n in head), F.hex(F.encode(x, "utf-8")))


def index_extra_hex() -> Column:
    """The integrity block before its hash is known."""
    return F.concat(le_hex(F.lit(c.EXTRA_HASH), 2), le_hex(F.lit(8), 2), F.repeat(F.lit("00"), 8))
