"""Spark helpers shared by the operators: inputs, shared folders, cut lineage, new columns beside any others."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.llm.textkit import trim

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Texts can be long: batches that scans and Python hold are small.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
}
#: Settings under which tables are written: a job's shuffle files go with it.
WRITING = SMALL_BATCHES | {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def configure(spark: SparkSession) -> None:
    """For applications, such as the queries and the pipeline: small batches in whatever their session runs. Operators leave sessions alone."""
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)
    give_back(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all of its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as a job runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Tables of keep() that are there still.
_left: set[str] = set()


@atexit.register
def _sweep() -> None:
    """When the driver ends, tables go that results of its session were read from."""
    from pyarrow import fs

    for path in _left:
        with suppress(OSError):
            store, place = fs.FileSystem.from_uri(path)
            store.delete_dir(place)


#: Seconds between two times that the driver gives memory back, and when it last did.
GIVE_BACK_S = 5.0
_given_back = -GIVE_BACK_S


def give_back(spark: SparkSession) -> bool:
    """Give what the driver no longer uses back to the system, unless it has just done so; whether it did.

    Its heap, Spark's broadcasts and the compiler's memory grow with every job and are kept for the next ones: a run of many jobs over little data
    ends as large as one over much.
    """
    global _given_back
    if time.monotonic() - _given_back < GIVE_BACK_S:
        return False
    gc.collect()
    trim()
    spark._jvm.java.lang.System.gc()
    _given_back = time.monotonic()
    return True


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors. by: a column of few values that are files of their own, see forget_part."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._kept = path
    _left.add(path)
    return out


#: Bytes of a group of rows in tables that workers write.
GROUP_BYTES = 8 << 20


def _write_part(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a partition's rows to one file of its number, which has its name only when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.parquet"
        aside = f"{folder}/_{name}-{task.taskAttemptId()}"
        writer, held, size = None, [], 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                writer = writer or pq.ParquetWriter(aside, batch.schema, write_page_checksum=True)
                held.append(batch)
                size += batch.nbytes
                if size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
        finally:
            if writer:
                writer.close()
        if writer:
            os.replace(aside, f"{folder}/{name}")
        held = []
        trim()
        yield from ()

    return run


def keep_numbers(df: DataFrame, name: str) -> DataFrame:
    """keep() for tables of numbers and lists of numbers: where the shared folder is a local one, Python workers write the files.

    Hadoop's local store starts a chmod for every file, checksum file and folder that it makes. Between its start and its exec that process shows
    all of the JVM's memory as its own, so an executor that writes many files looks twice as large to whoever watches its processes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return keep(df, name)
    folder = at.toUri().getPath()
    os.makedirs(folder)
    _left.add(path)
    with settings(spark, WRITING):
        df.mapInArrow(_write_part(folder), "rows long").write.format("noop").mode("overwrite").save()
    give_back(spark)
    out = spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path).select(*df.columns)
    out._kept = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of keep() that nothing reads any more; what is left goes with the driver."""
    for df in tables:
        delete(df.sparkSession, df._kept)
        _left.discard(df._kept)


def forget_part(df: DataFrame, by: str, *values: int) -> None:
    """Delete the rows of some values of the column that a table was kept by; nothing may ask for them any more."""
    for value in values:
        delete(df.sparkSession, f"{df._kept}/{by}={value}")


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pre_lower(column: str) -> Column:
    """A-Z to a-z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def place(docs: DataFrame, name: str) -> int:
    """Where a column stands: the one of just this name, else of this name in other letters."""
    return docs.columns.index(name) if name in docs.columns else [c.lower() for c in docs.columns].index(name.lower())


def beside(docs: DataFrame, kernel: Callable[[pa.Array], list[pa.Array]], fields: list[StructField], text: str = "text") -> DataFrame:
    """(row, fields...): every row of docs as one struct, whatever its columns are called, and what the kernel has for its text.

    Columns go by their place, so their names, repeated ones among them, cannot clash with anything; see rows_of and joined.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    names, at = ["row", *(f.name for f in fields)], place(docs, text)
    whole = plain.schema[at].dataType == StringType()  # else the text is sent once more, as a string

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at) if whole else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *kernel(texts)], names=names)
        trim()

    row = F.struct(*plain.columns).alias("row")
    packed = plain.select(row) if whole else plain.select(row, F.col(f"c{at}").cast("string").alias("text"))
    return packed.mapInArrow(run, StructType([StructField("row", plain.schema, False), *fields]))


def rows_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs in a table of beside(), with their own columns and values."""
    return found.select("row.*").toDF(*docs.columns)


def joined(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs and the new columns of beside(), which take the place of columns of the same name (in whatever letters)."""
    new = found.columns[1:]
    taken = {c.lower() for c in new}
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in taken]
    return found.select(*(F.col(f"row.c{k}") for k in kept), *new).toDF(*(docs.columns[k] for k in kept), *new)
