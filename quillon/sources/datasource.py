"""A Python data source for the parts of an archive: USING quillon OPTIONS (path, view).

Views: header, index, central_directory, segments, manifest.  reader reads manifests by Spark's Parquet scan instead, which
prunes columns and pushes filters down; the view manifest is for SQL alone and reads a row group a task.  A directory is read by as many tasks as it has
blocks of records: each asks for the bytes of its own block, and for local headers that lie near each other at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from quillon import codec
from quillon import constants as c
from quillon.sources import io
from quillon.sources.tablefunctions import embedded, manifest_schema, manifest_table

SCHEMAS = {
    "header": "path string, archive_size long, index_size long, version int, profile int, n_entries long, stored_hash string, computed_hash string",
    "index": "ord int, name string, offset decimal(20,0), size decimal(20,0)",
    "central_directory": "ord long, name string, flags int, method int, crc long, csize long, usize long, lfh_offset long, extra_len int, offset long",
    "segments": "label string, kind string, start long, end long",
}
#: Directory records of a partition.
RECORDS = 50_000


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon"

    def _view(self) -> str:
        view = self.options.get("view", "index")
        if view != "manifest" and view not in SCHEMAS:
            raise ValueError(f"view is one of {sorted([*SCHEMAS, 'manifest'])}, not {view!r}")
        return view

    def schema(self) -> str | StructType:
        view = self._view()
        if view == "manifest":
            return from_arrow_schema(manifest_schema(embedded(self.options["path"]), self._vsi()))
        return SCHEMAS[view]

    def _vsi(self) -> bool:
        return self.options.get("gdal_vsi", "true").lower() != "false"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self._view(), self._vsi())


class Part(InputPartition):
    def __init__(self, *of: int):
        super().__init__(of)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, view: str, vsi: bool = True):
        self.path, self.view, self.vsi = path, view, vsi

    def partitions(self) -> list[InputPartition]:
        if self.view == "central_directory":
            return [Part(*p) for p in io.directory_parts(io.Source(self.path), RECORDS)]
        if self.view == "manifest":
            return [Part(k) for k in range(embedded(self.path).num_row_groups)]
        return [Part()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source = io.Source(self.path)
        return getattr(self, "_" + self.view)(source, *partition.value)

    def _header(self, source: io.Source, *_) -> Iterator[tuple]:
        size, digest = codec.parse_index_header(source.get(0, c.INDEX_LFH))
        index = io.bootstrap(source)
        yield self.path, source.size, size, index.version, index.profile, len(index.entries), f"{digest:#018x}", f"{io.archive_hash(source, size):#018x}"

    def _index(self, source: io.Source, *_) -> Iterator[tuple]:
        from decimal import Decimal

        for k, (name, offset, size) in enumerate(io.bootstrap(source).entries):
            yield k, name, Decimal(offset), Decimal(size)

    def _central_directory(self, source: io.Source, first: int, end: int, start: int, stop: int) -> Iterator[tuple]:
        for e, offset in io.payload_offsets(source, list(codec.parse_directory(source.get(start, stop - start), end - first, first))):
            yield e.ord, e.name, e.flags, e.method, e.crc, e.csize, e.usize, e.lfh_offset, e.extra_len, offset

    def _manifest(self, source: io.Source, group: int) -> Iterator[pa.RecordBatch]:
        yield from manifest_table(embedded(self.path).read_row_group(group), self.path, self.vsi).to_batches()

    def _segments(self, source: io.Source, *_) -> Iterator[tuple]:
        size, _ = codec.parse_index_header(source.get(0, c.INDEX_LFH))
        yield "index header", "index-lfh", 0, c.INDEX_LFH
        yield "index", "index", c.INDEX_LFH, c.INDEX_LFH + size
        end, entries = io.directory(source)
        for e, offset in io.payload_offsets(source, [e for e in entries if e.name != c.INDEX_NAME]):
            padding = e.name == c.PADDING_NAME
            yield "padding" if padding else e.name, "padding" if padding else "file", e.lfh_offset, offset + e.csize
        yield "central directory", "cd", end.at, end.at + end.size
        yield "end of central directory", "eocd", end.at + end.size, source.size


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
