"""Writing archives: staging of manifests, parallel parts at planned offsets, one sequential commit.

Entries are planned by a query on their names and sizes alone; tasks then write parts (local headers and payloads, and the directory records of the same
entries) side by side, a part for each region of the archive; the commit streams them together.  All that the integrity hash covers is known before the first byte
is written, so the archive is written once, front to back, and nothing is patched.

Archives, parts and files go through pyarrow's file systems.  Parts lie beside the archive, so its store must be one that all machines share; a local path
is for one machine.  Plans and manifests on their way lie in the shared folder (see store).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import codec
from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.operators import validate
from quillon.plans import layout
from quillon.sources.io import Source
from quillon.sources.store import COPY, absolute, chunks, kept, remove, resolved, scratch

#: A part of an archive holds about so many bytes at most, and one at least.
MOST_PART, LEAST_PART = 256 << 20, 1 << 20
#: Files up to this size are read once and held; longer ones are read for their checksum and again to be written.
HELD = 16 << 20


def with_order(df: DataFrame) -> DataFrame:
    """ord, where the input has none: rows in their order of reading."""
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def with_sizes(entries: DataFrame) -> DataFrame:
    """Adds size, the bytes of the file at path, found by the executors; a file that is missing is an error."""
    names = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, path in zip(batch.column("name").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    sizes.append(Source(path).size)
                except OSError:
                    raise FileNotFoundError(f"the source of {name!r} does not exist: {path}") from None
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sizes, pa.int64())], names=[*names, "size"])

    return entries.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", size long")


def stage_metadata(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, paths) of an input table with name, path and extra columns.

    The manifest has name, offset, size and the extras; paths has ord, name and path. Both carry ord, as rows have no order
    of their own. Files are only asked for their sizes.
    """
    validate.check_input_columns(table)
    rows = with_order(table)
    validate.raise_first(validate.input_faults(rows))
    planned = layout.plan_flat(with_sizes(rows))
    extras = [x for x in table.columns if x not in ("name", "path", "ord")]
    number = lambda x: F.col(x).cast("decimal(20,0)").alias(x)
    return planned.select("ord", "name", number("offset"), number("size"), *extras), planned.select("ord", "name", "path")


def write_manifest(manifest: DataFrame, path: str, metadata: dict[str, str] | None = None, row_group: int = 100_000) -> str:
    """Write the manifest as one Parquet file with unsigned 64-bit offset and size, in order of ord; key-value metadata is carried in the schema."""
    names = [x for x in manifest.columns if x != "ord"]
    return write_table(manifest.orderBy("ord").select(*names), path, dict.fromkeys(c.RESERVED_COLUMNS, pa.uint64()), metadata, row_group)


def write_table(rows: DataFrame, path: str, kinds: dict[str, pa.DataType] | None = None, metadata: dict[str, str] | None = None, row_group: int = 100_000) -> str:
    """Write sorted rows of any number as one Parquet file, in their order. kinds: types of columns, where they are not Spark's.

    Spark sorts and writes pieces to the shared folder, and these are read in order, a batch at a time.
    """
    kinds = kinds or {}
    pieces = f"{scratch(rows.sparkSession)}/manifest-{uuid.uuid4().hex}"
    rows.write.parquet(pieces)
    store, place = resolved(pieces)
    try:
        from pyarrow import fs

        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet"))
        schema = pa.schema([pa.field(f.name, kinds[f.name]) if f.name in kinds else f.remove_metadata() for f in pq.read_schema(files[0], filesystem=store)])
        if metadata:
            schema = schema.with_metadata(metadata)
        target, name = resolved(path)
        with target.open_output_stream(name, compression=None) as out, pq.ParquetWriter(out, schema) as writer:
            held, n = [], 0
            for file in files:
                with store.open_input_file(file) as f:
                    for batch in pq.ParquetFile(f).iter_batches():
                        held.append(pa.Table.from_batches([batch]).replace_schema_metadata(None).cast(schema.remove_metadata()).replace_schema_metadata(schema.metadata))
                        n += len(batch)
                        if n >= row_group:
                            writer.write_table(pa.concat_tables(held), row_group_size=row_group)
                            held, n = [], 0
            if held:
                writer.write_table(pa.concat_tables(held), row_group_size=row_group)
        return path
    finally:
        remove(pieces)


def manifest_bytes(manifest: DataFrame, metadata: dict[str, str] | None = None, row_group: int = 100_000) -> bytes:
    """write_manifest for small manifests, as bytes."""
    path = f"{scratch(manifest.sparkSession)}/manifest-{uuid.uuid4().hex}.parquet"
    try:
        return b"".join(chunks(write_manifest(manifest, path, metadata, row_group)))
    finally:
        store, place = resolved(path)
        if store.get_file_info(place).size is not None:
            store.delete_file(place)


def _payload(path: str | None, data: bytes | None, size: int) -> Iterator[bytes]:
    if data is not None:
        yield data
        return
    source = Source(path)
    for at in range(0, size, COPY):
        yield source.get(at, min(COPY, size - at))
    source.close()


PARTS = "first long, part string, records string, part_bytes long, record_bytes long, entries long"


def write_parts(planned: DataFrame, folder: str, partitions: int | None = None, whole: int | None = None) -> DataFrame:
    """Write local headers and payloads, and directory records, of the regions of an archive. A row per part.

    whole: where the last payload ends, if it is known; regions are then as many as partitions, within the sizes of a part.
    """
    n = partitions or int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    region = min(MOST_PART, max(LEAST_PART if partitions is None else 1, -(-(whole or n * MOST_PART) // n)))
    rows = planned.withColumn("_region", F.floor(F.col("lfh_offset") / region)).repartition(n, "_region").sortWithinPartitions("_region", "ord")
    has = set(planned.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place_ = resolved(folder)
        store.create_dir(place_, recursive=True)
        part = None

        class Part:
            """A part of this attempt: what a lost task left is not listed."""

            def __init__(self, region: int, first: int, at: int):
                self.region, self.first, self.start = region, first, at
                self.name = uuid.uuid4().hex
                self.out, self.records = (store.open_output_stream(f"{place_}/{self.name}.{x}", compression=None) for x in ("part", "records"))
                self.size = self.record_size = self.count = 0

            def add(self, name: str, path: str | None, data: bytes | None, size: int, at: int) -> None:
                if data is not None and len(data) != size:
                    raise ArchiveError("INVALID_OFFSET", f"{name!r} has {len(data)} bytes, planned {size}")
                if data is None and size <= HELD:
                    data = b"".join(_payload(path, None, size))
                crc = 0
                for piece in _payload(path, data, size):
                    crc = zlib.crc32(piece, crc)
                head = codec.local_header(name.encode(), size, crc)
                self.out.write(head)
                for piece in _payload(path, data, size):
                    self.out.write(piece)
                self.size += len(head) + size
                if at - self.start + len(head) + size != self.size:
                    raise ArchiveError("INVALID_OFFSET", f"{name!r} was not written where it was planned")
                record = codec.directory_record(name.encode(), size, crc, at)
                self.records.write(record)
                self.record_size, self.count = self.record_size + len(record), self.count + 1

            def done(self) -> pa.RecordBatch:
                self.out.close()
                self.records.close()
                own = (self.first, f"{folder}/{self.name}.part", f"{folder}/{self.name}.records", self.size, self.record_size, self.count)
                return pa.RecordBatch.from_arrays([pa.array([x]) for x in own], names=[f.split()[0] for f in PARTS.split(", ")])

        for batch in batches:
            pick = lambda x, b=batch: b.column(x).to_pylist() if x in has else [None] * b.num_rows
            for region_, ord_, *of in zip(batch.column("_region").to_pylist(), *(pick(x) for x in ("ord", "name", "path", "data", "size", "lfh_offset")), strict=True):
                if part is None or part.region != region_:
                    if part is not None:
                        yield part.done()
                    part = Part(region_, ord_, of[-1])
                part.add(*of)
        if part is not None:
            yield part.done()

    return rows.mapInArrow(run, PARTS)


def write_archive(entries: DataFrame, out: str, profile: str = "none", manifest: bytes | str | None = None, partitions: int | None = None) -> str:
    """Write an archive from ord, name, size, in_index and path or data; returns its absolute path or URI.

    flat: entries and then the manifest (bytes, or a Parquet file's path), which alone is in the index.  levels: COLLECTION.json and METADATA/*.parquet come last and are in
    the index.  A padding entry brings small archives to the least size.  ord must be there once for every entry, without nulls.
    """
    spark: SparkSession = entries.sparkSession
    out = absolute(out)
    folder = f"{out}.parts-{uuid.uuid4().hex}"
    store, place = resolved(folder)
    store.create_dir(place, recursive=True)
    try:
        if profile == "flat" and manifest is None:
            raise ValueError("a flat archive needs a manifest")
        narrow = [x for x in ("ord", "name", "size", "in_index") if x in entries.columns]
        heavy = [x for x in ("path", "data") if x in entries.columns]
        with kept(entries.select(*narrow), "entries") as plain:
            return _committed(spark, entries.select("ord", *heavy), plain, out, folder, profile, manifest, partitions)
    finally:
        remove(folder)


def _committed(spark: SparkSession, heavy: DataFrame, entries: DataFrame, out: str, folder: str, profile: str, manifest: bytes | str | None, partitions: int | None) -> str:
    """heavy: ord with path or data. entries: a written table of ord, name, size and in_index."""
    span = (entries.agg(F.max("ord")).first()[0] or 0) + 1
    if profile == "levels":
        priority = (F.col("name") == c.COLLECTION_NAME) | (F.col("name").startswith(c.LEVEL_DIR) & F.col("name").endswith(".parquet"))
        entries = entries.withColumn("in_index", priority).withColumn("own", F.col("ord")).withColumn("ord", F.when(priority, F.col("ord") + span + 1).otherwise(F.col("ord")))
    else:
        entries = entries.withColumn("own", F.col("ord"))
        if profile == "flat" or "in_index" not in entries.columns:
            entries = entries.withColumn("in_index", F.lit(False))
    reserved = (c.INDEX_NAME, c.PADDING_NAME) + ((c.MANIFEST_NAME,) if profile == "flat" else ())
    validate.raise_first(validate.entry_faults(entries, reserved=reserved).unionByName(validate.order_faults(entries)))
    manifest_size = 0 if manifest is None else len(manifest) if isinstance(manifest, bytes) else Source(manifest).size

    def planned_with(df: DataFrame) -> tuple[DataFrame, list[tuple[str, int, int]], int, int]:
        plan = layout.plan_flat(df) if profile == "flat" else layout.plan(df)
        facts = plan.agg(F.max(F.col("offset") + F.col("size")).alias("end"), layout.directory_size().alias("cd")).first()
        if profile == "flat":
            at = (facts["end"] or c.FLAT_BASE) + c.LFH_FIXED + len(c.MANIFEST_NAME) + (c.ZIP64_LFH_EXTRA if manifest_size >= c.SENTINEL32 else 0)
            return plan, [(c.MANIFEST_NAME, at, manifest_size)], at + manifest_size, facts["cd"] + c.CDH_FIXED + len(c.MANIFEST_NAME)
        # The index is one object, which readers hold too.
        index = [(r["name"], r["offset"], r["size"]) for r in plan.where("in_index").orderBy("ord").select("name", "offset", "size").collect()]
        size = sum(c.INDEX_ENTRY + len(n.encode()) for n, _, _ in index) + c.INDEX_HEADER
        return plan, index, facts["end"] or c.INDEX_LFH + size, facts["cd"]

    plan, index, end, cd = planned_with(entries)
    lack = c.LEAST_ARCHIVE - (end + cd + c.EOCD_FIXED)
    pad = max(lack - c.PADDING_COST, 1) if lack > 0 else 0
    if pad and profile != "flat":
        row = spark.createDataFrame([(span, -1, c.PADDING_NAME, pad, False)], "ord long, own long, name string, size long, in_index boolean")
        entries = entries.unionByName(row.select(*entries.columns))
        plan, index, end, cd = planned_with(entries)
    payload = codec.index_payload(c.PROFILE_CODES[profile], index)
    if len(payload) >= c.SENTINEL32:
        raise ArchiveError("INVALID_ZIP64", "the index would need ZIP64")
    with kept(plan.select("ord", "own", "name", "size", "lfh_offset"), "plan") as plan:
        rows = plan.withColumnRenamed("ord", "_ord").join(heavy.withColumnRenamed("ord", "own"), "own", "left").withColumnRenamed("_ord", "ord")
        if pad and profile != "flat":
            padding = F.repeat(F.lit(chr(c.PADDING_BYTE)), pad).cast("binary")
            rows = rows.withColumn("data", F.when(F.col("own") == -1, padding).otherwise(F.col("data") if "data" in rows.columns else F.lit(None).cast("binary")))
        parts = sorted(write_parts(rows.drop("own"), folder, partitions, end).collect())  # a row per part

    own: list[tuple[bytes, bytes | str]] = [(c.MANIFEST_NAME.encode(), manifest)] if profile == "flat" else []
    if profile == "flat" and pad:
        own.append((c.PADDING_NAME.encode(), bytes([c.PADDING_BYTE]) * pad))
    at = c.INDEX_LFH + len(payload) + sum(p["part_bytes"] for p in parts)
    tail: list[bytes | str] = []
    records = []
    for name, data in own:
        size, crc = 0, 0
        for piece in _read(data):
            size, crc = size + len(piece), zlib.crc32(piece, crc)
        head = codec.local_header(name, size, crc)
        records.append(codec.directory_record(name, size, crc, at))
        tail += [head, data]
        at += len(head) + size
    index_crc = zlib.crc32(payload)
    first = codec.directory_record(c.INDEX_NAME.encode(), len(payload), index_crc, 0)
    cd_size = len(first) + sum(p["record_bytes"] for p in parts) + sum(map(len, records))
    final = codec.end_records(1 + len(own) + sum(p["entries"] for p in parts), cd_size, at)
    pieces: list[bytes | str] = [payload, *(p["part"] for p in parts), *tail, first, *(p["records"] for p in parts), *records, final]
    whole = at + cd_size + len(final)
    if whole < c.LEAST_ARCHIVE:
        raise ArchiveError("ARCHIVE_TOO_SMALL", f"{whole} bytes")
    head = codec.local_header(c.INDEX_NAME.encode(), len(payload), index_crc, codec.hash_extra(_hash(pieces, len(payload), whole)))
    store, unfinished = resolved(f"{folder}/archive")
    written = len(head)
    with store.open_output_stream(unfinished, compression=None) as f:
        f.write(head)
        for piece in pieces:
            for data in _read(piece):
                f.write(data)
                written += len(data)
    if written != whole:
        raise ArchiveError("INVALID_OFFSET", f"wrote {written} bytes, predicted {whole}")
    store.move(unfinished, resolved(out)[1])
    return out


def _read(piece: bytes | str, start: int = 0) -> Iterator[bytes]:
    if isinstance(piece, bytes):
        yield piece[start:]
    else:
        yield from chunks(piece, start)


def _hash(pieces: list[bytes | str], index_size: int, whole: int) -> int:
    """The integrity hash of an archive whose bytes after the first header are the pieces."""
    h = c.FNV_BASIS
    sizes = [len(piece) if isinstance(piece, bytes) else Source(piece).size for piece in pieces]
    for a, b in codec.hash_ranges(index_size, whole):
        place = c.INDEX_LFH
        for piece, size in zip(pieces, sizes, strict=True):
            if place + size > a and place < b:
                at = max(place, a)
                for data in _read(piece, at - place):
                    data = data[: b - at]
                    h = codec.fnv1a64(data, h)
                    at += len(data)
                    if at >= b:
                        break
            place += size
    return h


def create(out: str, table: DataFrame, metadata: dict[str, str] | None = None) -> str:
    """Write a flat archive of the files in a table of name, path and extra columns; returns its absolute path or URI."""
    manifest, paths = stage_metadata(with_order(table))
    path = f"{scratch(table.sparkSession)}/manifest-{uuid.uuid4().hex}.parquet"
    try:
        return _flat(out, paths, write_manifest(manifest, path, metadata))
    finally:
        store, place = resolved(path)
        if store.get_file_info(place).size is not None:
            store.delete_file(place)


def stage_create(out: str, paths: DataFrame, parquet: str, check: bool = True) -> str:
    """Embed a manifest's Parquet file unchanged and pack the files of paths (ord, name, path).

    check: hold every name, offset and size of the manifest against the plan.
    """
    parquet = absolute(parquet)
    store, place = resolved(parquet)
    validate.check_manifest_columns(pq.read_schema(place, filesystem=store).names)
    if check:
        validate.raise_first(stage_faults(paths, parquet))
    return _flat(out, paths, parquet)


def stage_faults(paths: DataFrame, parquet: str) -> DataFrame:
    """Where a manifest's Parquet file differs from the plan of paths (ord, name, path); ord is that of paths, and of rows that paths lack the place in the file."""
    manifest = paths.sparkSession.read.parquet(parquet if "://" in parquet else "file://" + absolute(parquet)).select("name", "offset", "size")
    manifest = manifest.withColumn("_at", F.monotonically_increasing_id())
    planned = layout.plan_flat(with_sizes(paths)).select("ord", "name", "offset", "size", F.col("ord").alias("own"))
    return validate.positional_faults(validate.numbered(planned, "ord"), validate.numbered(manifest, "_at"), "own")


def _flat(out: str, paths: DataFrame, manifest: bytes | str) -> str:
    return write_archive(with_sizes(paths.select("ord", "name", "path")), out, "flat", manifest)


def entries_of(table: DataFrame, data: str | None = None) -> DataFrame:
    """Entries of a table with name and a binary column, or with name and path."""
    rows = with_order(table)
    if data is None:
        return with_sizes(rows)
    return rows.withColumn("data", F.col(data)).withColumn("size", F.length("data").cast("long"))


def index_bytes_faults(entries: DataFrame) -> DataFrame:
    """Whether the index would need ZIP64."""
    size = layout.index_payload_size(F.col("in_index"))
    return entries.agg(size.alias("n")).where(F.col("n") >= c.SENTINEL32).select(F.lit("INVALID_ZIP64").alias("code"), F.col("n").cast("string").alias("detail"))


