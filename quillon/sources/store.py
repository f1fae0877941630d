"""Files in any store that pyarrow knows, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

COPY = 1 << 20


def resolved(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def absolute(path: str) -> str:
    """A local path made absolute; URIs as they are."""
    return path if "://" in path else os.path.abspath(path)


def scratch(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or where that is unset and all runs on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all of its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quillon"


@contextmanager
def kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A table in the shared folder for as long as it is needed: plans that read it several times compute it once."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(path)


def remove(path: str) -> None:
    """Delete a folder with all that is in it; nothing where there is none."""
    store, place = resolved(path)
    try:
        store.delete_dir(place)
    except FileNotFoundError:
        pass


def chunks(path: str, start: int = 0) -> Iterator[bytes]:
    store, place = resolved(path)
    with store.open_input_file(place) as f:
        f.seek(start)
        while data := f.read(COPY):
            yield data
