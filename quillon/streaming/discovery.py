"""Incremental catalogs: new shard manifests are picked up by a file stream and appended, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.sources.reader import with_vsi


def shard_stream(spark: SparkSession, folder: str, schema: StructType, base: str, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of manifests (*.parquet) that arrive in a folder, with shard (the archive beside the manifest) and virtual path."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)
    shard = F.replace(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1), F.lit(".parquet"), F.lit(".zip"))
    return with_vsi(rows.withColumn("shard", shard), F.concat(F.lit(base), F.col("shard")))


def append_catalog(stream: DataFrame, catalog: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to a catalog folder, and stop; run again for what came later."""
    return stream.writeStream.format("parquet").option("path", catalog).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Entries and bytes that arrived in each window (ts, size), with a watermark for late ones; for streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every)).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")).select(F.col("window.start").alias("start"), "entries", "bytes")
