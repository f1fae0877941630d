"""Sizes, names and codes of the archive format."""

from __future__ import annotations

# Sizes in bytes.
LFH_FIXED = 30
CDH_FIXED = 46
EOCD_FIXED = 22
EOCD64_FIXED = 56
LOCATOR64_FIXED = 20
ZIP64_LFH_EXTRA = 20
INDEX_LFH = 51
INDEX_EXTRA = 12
INDEX_HEADER = 11
INDEX_ENTRY = 18
HASH_WINDOW = 32768
HASH_AT = 43
LEAST_ARCHIVE = HASH_WINDOW + INDEX_LFH
BOOTSTRAP = 65536
MAX_NAME = 65535
SENTINEL16 = 0xFFFF
SENTINEL32 = 0xFFFFFFFF

# Signatures, flags and marks.
SIG_LFH = 0x04034B50
SIG_CDH = 0x02014B50
SIG_EOCD = 0x06054B50
SIG_EOCD64 = 0x06064B50
SIG_LOCATOR64 = 0x07064B50
MAGIC = b"CZIP"
VERSION = 1
EXTRA_HASH = 0xCA0C
EXTRA_ZIP64 = 0x0001
FLAG_ENCRYPTED, FLAG_DESCRIPTOR, FLAG_STRONG, FLAG_UTF8, FLAG_MASKED = 1 << 0, 1 << 3, 1 << 6, 1 << 11, 1 << 13
DOS_DATE = 0x0021
DOS_TIME = 0

# Reserved names, columns, profiles.
INDEX_NAME = "__cozip__"
PADDING_NAME = "__cozip_padding__"
MANIFEST_NAME = "__metadata__"
COLLECTION_NAME = "COLLECTION.json"
LEVEL_DIR = "METADATA/"
VSI_COLUMN = "cozip:gdal_vsi"
PADDING_BYTE = 0x5A
PROFILES = {0: "none", 1: "flat", 2: "levels"}
PROFILE_CODES = {name: code for code, name in PROFILES.items()}
RESERVED_NAMES = (INDEX_NAME, PADDING_NAME, MANIFEST_NAME)
RESERVED_COLUMNS = ("offset", "size")

# Status codes of the binary interface.
STATUSES = {0: "OK", 1: "INVALID_LFH", 2: "ARCHIVE_TOO_SMALL", 100: "INVALID_ARGUMENT", 101: "BUFFER_TOO_SMALL", 102: "IO"}

# Canonical error codes.
ERROR_CODES = (
    "INVALID_LFH",
    "INVALID_MAGIC",
    "UNSUPPORTED_VERSION",
    "UNKNOWN_PROFILE",
    "HASH_MISMATCH",
    "ARCHIVE_TOO_SMALL",
    "TRUNCATED_INDEX",
    "DUPLICATE_NAME",
    "INVALID_NAME",
    "MISSING_ENTRY",
    "INVALID_OFFSET",
    "INVALID_ZIP_STRUCTURE",
    "INVALID_ZIP64",
)

# 64-bit FNV-1a.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

#: Where the first entry of a flat archive begins: its index holds the manifest alone.
FLAT_BASE = INDEX_LFH + INDEX_HEADER + INDEX_ENTRY + len(MANIFEST_NAME)
#: What a padding entry costs beside its payload: header, directory record and its name twice.
PADDING_COST = LFH_FIXED + CDH_FIXED + 2 * len(PADDING_NAME)
