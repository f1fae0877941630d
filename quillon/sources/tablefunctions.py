"""SQL table functions: select * from read_archive('/data/ds.zip', false).

A table function is one task.  It reads its manifest a row group at a time; for distributed scans in SQL there is the data source
(create view ... using quillon options (path, view 'manifest')), and in Python reader.read and reader.create_view.
"""

from __future__ import annotations

import io as pyio
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillon import constants as c
from quillon.functions.expressions import vsi_base
from quillon.sources import io


class Ranges(pyio.RawIOBase):
    """A stretch of an archive as a file that is read by ranges."""

    def __init__(self, source: io.Source, offset: int, size: int):
        self.source, self.offset, self.size, self.at = source, offset, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        data = self.source.get(self.offset + self.at, n) if n > 0 else b""
        self.at += len(data)
        return data


def embedded(source: str) -> pq.ParquetFile:
    """The manifest of an archive, opened in place: schema and row groups are read by ranges."""
    opened = io.Source(source)
    place = io.bootstrap(opened).find(c.MANIFEST_NAME)
    if place is None:
        raise ValueError(f"{source} has no {c.MANIFEST_NAME}")
    return pq.ParquetFile(pa.PythonFile(Ranges(opened, *place), mode="r"))


def manifest_schema(file: pq.ParquetFile, gdal_vsi: bool = True) -> pa.Schema:
    fields = [pa.field(f.name, pa.decimal128(20, 0)) if f.name in c.RESERVED_COLUMNS else f for f in file.schema_arrow]
    return pa.schema([*fields, pa.field(c.VSI_COLUMN, pa.string())] if gdal_vsi else fields)


def manifest_table(table: pa.Table, source: str, gdal_vsi: bool = True) -> pa.Table:
    """Rows of a manifest with whole decimals and, on demand, virtual paths."""
    for name in c.RESERVED_COLUMNS:
        table = table.set_column(table.schema.get_field_index(name), name, table.column(name).cast(pa.decimal128(20, 0)))
    if gdal_vsi:
        paths = [f"/vsisubfile/{o}_{s},{vsi_base(source)}" for o, s in zip(table.column("offset").to_pylist(), table.column("size").to_pylist(), strict=True)]
        table = table.append_column(c.VSI_COLUMN, pa.array(paths, pa.string()))
    return table


@udtf
class ReadArchive:
    """read_archive(path [, gdal_vsi])"""

    @staticmethod
    def analyze(path: AnalyzeArgument, gdal_vsi: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(from_arrow_schema(manifest_schema(embedded(path.value), gdal_vsi is None or gdal_vsi.value)))

    def eval(self, path: str, gdal_vsi: bool = True) -> Iterator[tuple]:
        file = embedded(path)
        for k in range(file.num_row_groups):
            for batch in manifest_table(file.read_row_group(k), path, gdal_vsi).to_batches():
                yield from zip(*(batch.column(x).to_pylist() for x in range(batch.num_columns)), strict=True)


def register(spark: SparkSession) -> None:
    spark.udtf.register("read_archive", ReadArchive)


def path_batches(df: DataFrame, size: int = 256, column: str = c.VSI_COLUMN) -> Iterator[list[str]]:
    """Virtual paths in batches for a data loader, a partition at a time."""
    held: list[str] = []
    for row in df.select(f"`{column}`").toLocalIterator():
        held.append(row[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
