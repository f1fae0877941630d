"""Archives, catalogs and hierarchical datasets as DataFrames."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.functions import expressions as x
from quillon.sources import io
from quillon.sources.store import resolved, scratch

MANIFEST_COLUMNS = ("name", "offset", "size")
CATALOG_COLUMNS = (*MANIFEST_COLUMNS, "shard")


def _required(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"{what} lacks required column(s) {missing}")


def read(spark: SparkSession, source: str, gdal_vsi: bool = True, verify: bool = True) -> DataFrame:
    """The manifest of an archive (*.zip) or a catalog (*INDEX.parquet), by suffix, with virtual paths.

    The scan is Spark's own Parquet scan, so filters and columns are pushed down to it.
    """
    if source.endswith("INDEX.parquet"):
        return read_catalog(spark, source, gdal_vsi)
    if source.endswith(".zip"):
        return read_archive(spark, source, gdal_vsi, verify)
    raise ValueError(f"{source!r} is neither an archive (.zip) nor a catalog (INDEX.parquet)")


def read_archive(spark: SparkSession, source: str, gdal_vsi: bool = True, verify: bool = True) -> DataFrame:
    opened = io.Source(source)
    index = io.bootstrap(opened, verify)
    place = index.find(c.MANIFEST_NAME)
    if place is None:
        raise ValueError(f"{source} has no {c.MANIFEST_NAME}; its priority files are {sorted(n for n, _, _ in index.entries)}")
    df = spark.read.parquet(io.cached_slice(opened, *place, folder=f"{scratch(spark)}/slices"))
    _required(df, MANIFEST_COLUMNS, f"the manifest of {source}")
    return with_vsi(df, F.lit(x.vsi_base(source))) if gdal_vsi else df


def read_catalog(spark: SparkSession, source: str, gdal_vsi: bool = True) -> DataFrame:
    df = spark.read.parquet(io.cached_slice(s, 0, s.size, f"{scratch(spark)}/slices") if x.is_url(source) and (s := io.Source(source)) else source)
    _required(df, CATALOG_COLUMNS, source)
    return with_vsi(df, F.concat(F.lit(x.vsi_base_dir(source)), F.col("shard"))) if gdal_vsi else df


def with_vsi(df: DataFrame, base: F.Column) -> DataFrame:
    return df.withColumn(c.VSI_COLUMN, x.vsi_path("offset", "size", base))


def create_view(spark: SparkSession, name: str, source: str, gdal_vsi: bool = True) -> None:
    """A manifest as a SQL view."""
    read(spark, source, gdal_vsi).createOrReplaceTempView(name)


def priority_files(source: str) -> dict[str, bytes]:
    """All indexed payloads by one range request."""
    opened = io.Source(source)
    index = io.bootstrap(opened)
    if not index.entries:
        return {}
    start, end = min(o for _, o, _ in index.entries), max(o + s for _, o, s in index.entries)
    region = opened.get(start, end - start)
    return {n: region[o - start : o - start + s] for n, o, s in index.entries}


class Dataset:
    """A hierarchical dataset: COLLECTION.json and a table for each level, in an archive or in a folder.

    The table of the samples is METADATA/collection.parquet; below it each level's rows have a parent_id.
    """

    def __init__(self, spark: SparkSession, source: str):
        self.spark, self.source, self.archive = spark, source, source.endswith(".zip")
        if self.archive:
            self.opened = io.Source(source)
            self.index = io.bootstrap(self.opened)
            files = [n for n, _, _ in self.index.entries]
            if self.index.profile != c.PROFILE_CODES["levels"]:
                raise ArchiveError("UNKNOWN_PROFILE", f"{source} has the profile {self.index.profile}")
            if c.COLLECTION_NAME not in files:
                raise ArchiveError("MISSING_ENTRY", f"{source} has no {c.COLLECTION_NAME}")
        else:
            from pyarrow import fs

            store, place = resolved(source)
            files = [c.LEVEL_DIR + posixpath.basename(f.path) for f in store.get_file_info(fs.FileSelector(f"{place}/{c.LEVEL_DIR.rstrip('/')}"))]
        self.levels = sorted(posixpath.basename(f).removesuffix(".parquet") for f in files if f.startswith(c.LEVEL_DIR) and f.endswith(".parquet"))

    @property
    def collection(self) -> dict:
        if self.archive:
            return json.loads(self.opened.get(*self.index.find(c.COLLECTION_NAME)))
        return json.loads(io.Source(f"{self.source}/{c.COLLECTION_NAME}").all())

    def level(self, name: str) -> DataFrame:
        """A level's table with virtual paths where it has internal:offset and internal:size."""
        name = name.replace("/", "__")
        if name not in self.levels:
            raise ValueError(f"{self.source} has the levels {self.levels}, not {name!r}")
        path = f"{c.LEVEL_DIR}{name}.parquet"
        if not self.archive:
            return self.spark.read.parquet(f"{self.source}/{path}")
        df = self.spark.read.parquet(io.cached_slice(self.opened, *self.index.find(path), folder=f"{scratch(self.spark)}/slices"))
        if {"internal:offset", "internal:size"} <= set(df.columns):
            df = df.withColumn(c.VSI_COLUMN, x.vsi_path(F.col("`internal:offset`"), F.col("`internal:size`"), F.lit(x.vsi_base(self.source))))
        return df


def read_dataset(spark: SparkSession, source: str, level: str = "sample", idx: int | tuple[int, int] | None = None, pivot: bool = False) -> DataFrame:
    """Rows of a level; idx is one sample or a half-open range of them; pivot gives one row per sample and a column of paths per leaf."""
    df = Dataset(spark, source).level(level)
    if isinstance(idx, int):
        df = df.where(F.col("parent_id") == idx)
    elif idx:
        df = df.where((F.col("parent_id") >= idx[0]) & (F.col("parent_id") < idx[1]))
    if pivot:
        from quillon.operators.hierarchy import wide

        df = wide(df, "parent_id", "id", c.VSI_COLUMN)
    return df


def read_samples(spark: SparkSession, source: str, idx: int | tuple[int, int] | None = None, level: str = "sample", leaves: list[str] | None = None) -> DataFrame:
    """One row per sample of a hierarchical dataset: idx (its place in METADATA/collection.parquet, from 0), the sample's columns and a column of virtual paths for each leaf.

    idx: one sample or a half-open range of them.  Rows of the level belong to the sample whose id is their parent_id; with the leaves given no
    extra pass finds them.
    """
    from quillon.operators.hierarchy import wide

    data = Dataset(spark, source)
    samples = data.level("collection")
    samples = samples.select(F.col("_metadata.row_index").alias("idx"), *(f"`{n}`" for n in samples.columns))
    if isinstance(idx, int):
        samples = samples.where(F.col("idx") == idx)
    elif idx:
        samples = samples.where((F.col("idx") >= idx[0]) & (F.col("idx") < idx[1]))
    paths = wide(data.level(level), "parent_id", "id", c.VSI_COLUMN, leaves)
    return samples.join(paths, samples["id"] == paths["parent_id"], "left").drop("parent_id")


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A manifest of samples as JSON lines; with a schema no extra pass infers one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)
