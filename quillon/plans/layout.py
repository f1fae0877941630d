"""Layout planning: where every entry of an archive lies, as an exclusive prefix sum over entries in order.

An entry relation has ord, name, size and in_index.  The prefix sum is two-level: sums of chunks of neighbouring
ords, a running sum over the chunks (one row each), and running sums within each chunk, so no task sees more than a chunk or
the table of chunk sums; that table is summed up in chunks again while it is large.  Rows with a null ord have no place; repeated
ords are told apart by name.  Both are faults (validate.order_faults), which writers refuse.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import constants as c
from quillon.functions.expressions import byte_length, lfh_size

#: Entries of a chunk; the table of chunk sums is as much shorter.
CHUNK = 4096


def prefix(df: DataFrame, value: Column, name: str, of: Callable[[Column], Column], order: str = "ord", chunk: int = CHUNK, levels: int = 2, by: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """Adds an aggregate (F.sum, F.max) of value over all rows before, null for the first; by a non-negative integer order, then the columns of `then`; `levels` of chunks.

    by: columns within which rows are ordered.  Rows without a place in the order (null) have no aggregate and play no part in others.
    """
    value_, chunk_, total_, own_, before_ = (f"_{x}{levels}" for x in ("value", "chunk", "total", "own", "before"))
    df = df.withColumn(value_, F.when(F.col(order).isNotNull(), value.cast("long"))).withColumn(chunk_, F.coalesce(F.floor(F.col(order) / chunk).cast("long"), F.lit(-1)))
    totals = df.groupBy(*by, chunk_).agg(of(value_).alias(total_))
    if levels > 1:
        earlier = prefix(totals.where(F.col(chunk_) >= 0), F.col(total_), before_, of, chunk_, chunk, levels - 1, by).select(*by, chunk_, before_)
    else:
        rows = W.partitionBy(*by).orderBy(chunk_).rowsBetween(W.unboundedPreceding, -1)
        earlier = totals.where(F.col(chunk_) >= 0).select(*by, chunk_, of(total_).over(rows).alias(before_))
    own = W.partitionBy(*by, chunk_).orderBy(order, *then).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn(own_, F.when(F.col(order).isNotNull(), of(value_).over(own)))
    for x in by:  # null-safe: rows of a null group are a group
        earlier = earlier.withColumnRenamed(x, f"_{x}_")
    found = df.join(earlier.withColumnRenamed(chunk_, "_chunk"), reduce(lambda a, b: a & b, (df[x].eqNullSafe(F.col(f"_{x}_")) for x in by), df[chunk_] == F.col("_chunk")), "left")
    some = F.filter(F.array(before_, own_), lambda x: x.isNotNull())
    both = F.array_max(some) if of is F.max else F.when(F.size(some) > 0, F.coalesce(before_, F.lit(0)) + F.coalesce(own_, F.lit(0)))
    return found.withColumn(name, both).drop(value_, chunk_, "_chunk", before_, own_, *(f"_{x}_" for x in by))


def prefix_sum(df: DataFrame, value: Column, name: str, order: str = "ord", chunk: int = CHUNK, levels: int = 2, by: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of value over all rows before, 0 for the first and null for rows without a place in the order."""
    found = prefix(df, value, name, F.sum, order, chunk, levels, by, then)
    return found.withColumn(name, F.when(F.col(order).isNotNull(), F.coalesce(name, F.lit(0))))


def index_payload_size(in_index: Column | None = None, name: str = "name") -> Column:
    """An aggregate: bytes of the index over the entries in it."""
    return (F.lit(c.INDEX_HEADER) + F.coalesce(F.sum(F.when(F.lit(True) if in_index is None else in_index, c.INDEX_ENTRY + byte_length(name))), F.lit(0))).cast("long")


def plan_from(entries: DataFrame, base: Column | int, levels: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Adds lfh_offset, lfh_size and offset to entries; base is where the first header begins."""
    sized = entries.withColumn("lfh_size", lfh_size("name", "size").cast("long"))
    out = prefix_sum(sized, F.col("lfh_size") + F.col("size"), "lfh_offset", "ord", chunk, levels, then=("name",))
    out = out.withColumn("lfh_offset", (F.col("lfh_offset") + (F.lit(base) if isinstance(base, int) else base)).cast("long"))
    return out.withColumn("offset", F.col("lfh_offset") + F.col("lfh_size"))


def plan_flat(entries: DataFrame, levels: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Entries of a flat archive: its index holds the manifest alone, which lies behind them, so their places depend on nothing else."""
    return plan_from(entries, c.FLAT_BASE, levels, chunk)


def plan(entries: DataFrame, levels: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Entries of an archive whose index holds those with in_index."""
    size = entries.agg(index_payload_size(F.col("in_index"))).scalar()
    return plan_from(entries, c.INDEX_LFH + size, levels, chunk)


def directory_size(name: str = "name") -> Column:
    """An aggregate: bytes of the central directory, the index entry's record with it (archives without ZIP64)."""
    return (F.coalesce(F.sum(c.CDH_FIXED + byte_length(name)), F.lit(0)) + c.CDH_FIXED + len(c.INDEX_NAME)).cast("long")


def predicted_size(index_size: Column) -> Column:
    """An aggregate over planned entries: bytes of the whole archive (without ZIP64)."""
    end = F.greatest(F.coalesce(F.max(F.col("offset") + F.col("size")), F.lit(0)), c.INDEX_LFH + index_size)
    return (end + directory_size() + c.EOCD_FIXED).cast("long")


def padding_size(predicted: Column | str) -> Column:
    """Payload bytes of the padding entry that an archive of the predicted size needs; 0 for none."""
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    lack = c.LEAST_ARCHIVE - p
    return F.when(lack <= 0, 0).otherwise(F.greatest(lack - c.PADDING_COST, F.lit(1))).cast("long")


def segments(planned: DataFrame, index_size: int) -> DataFrame:
    """The byte map of an archive without ZIP64: label, kind and [start, end)."""
    spark = planned.sparkSession
    last = planned.agg(F.coalesce(F.max(F.col("offset") + F.col("size")), F.lit(c.INDEX_LFH + index_size)).alias("at"), directory_size().alias("size"))
    head = spark.createDataFrame(
        [("index header", "index-lfh", 0, c.INDEX_LFH), ("index", "index", c.INDEX_LFH, c.INDEX_LFH + index_size)], "label string, kind string, start long, end long"
    )
    files = planned.select(
        F.when(F.col("name") == c.PADDING_NAME, "padding").otherwise(F.col("name")).alias("label"),
        F.when(F.col("name") == c.PADDING_NAME, "padding").otherwise("file").alias("kind"),
        F.col("lfh_offset").alias("start"),
        (F.col("offset") + F.col("size")).alias("end"),
    )
    tail = last.select(
        F.inline(
            F.array(
                F.struct(F.lit("central directory").alias("label"), F.lit("cd").alias("kind"), F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")),
                F.struct(F.lit("end of central directory").alias("label"), F.lit("eocd").alias("kind"), (F.col("at") + F.col("size")).alias("start"), (F.col("at") + F.col("size") + c.EOCD_FIXED).alias("end")),
            )
        )
    )
    return head.unionByName(files).unionByName(tail)
