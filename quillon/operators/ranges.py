"""Byte ranges: lookup by offset, coalescing of neighbours, overlap of regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.plans.layout import prefix, prefix_sum

#: Bytes of a bin for range joins; a range enters every bin it touches.
BIN = 1 << 20


def locate(points: DataFrame, segments: DataFrame, at: str = "at", bin_bytes: int = BIN) -> DataFrame:
    """Each point with the segment [start, end) that holds it; a bin equi-join, so it shuffles like any other."""
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_bytes))
    s = segments.where("end > start").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_bytes), F.floor((F.col("end") - 1) / bin_bytes))))
    return p.join(s, "_bin").where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("_bin")


def locate_asof(points: DataFrame, segments: DataFrame, at: str = "at", bin_bytes: int = BIN) -> DataFrame:
    """As locate, for segments that cover all bytes: the last segment that starts at or before a point, by a sort within bins.

    The segment that a bin starts in enters the bin with it, so bins need nothing of each other.
    """
    s = segments.where("end > start").select(
        F.explode(F.sequence(F.floor(F.col("start") / bin_bytes), F.floor((F.col("end") - 1) / bin_bytes))).alias("_bin"), F.col("start").alias("_pos"), F.lit(0).alias("_kind"), F.struct(*segments.columns).alias("_segment"), F.lit(None).alias("_point")
    )
    p = points.select(F.floor(F.col(at) / bin_bytes).alias("_bin"), F.col(at).alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).alias("_segment"), F.struct(*points.columns).alias("_point"))
    order = W.partitionBy("_bin").orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = s.unionByName(p).withColumn("_segment", F.last("_segment", ignorenulls=True).over(order))
    return both.where("_kind = 1").select("_point.*", "_segment.*").where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end")))


def coalesced(ranges: DataFrame, gap: int, by: list[str] | None = None, most: int | None = None, bin_bytes: int = 64 * BIN) -> DataFrame:
    """Adds range_group, group_start and group_end: ranges (offset, size) whose gaps are at most `gap` bytes are fetched at once.

    by: columns of the archive.  Places go by bins of offsets and the bins' greatest ends and sums, so no task sees a whole archive.
    most: a group does not go beyond a multiple of so many bytes.
    """
    by_ = tuple(by or ())
    end = F.col("offset") + F.col("size")
    # Dealt out once: all that follows reads this exchange.  Bins are few, so their totals need no chunks of their own.
    ranges = ranges.repartition(*by_, F.floor(F.col("offset") / bin_bytes))
    placed = prefix(ranges, end, "_reach", F.max, "offset", bin_bytes, 1, by_, ("size",))
    fresh = F.col("offset") > F.col("_reach") + gap
    if most:
        placed = prefix(placed, F.col("offset"), "_last", F.max, "offset", bin_bytes, 1, by_, ("size",))
        fresh = fresh | (F.floor(F.col("offset") / most) > F.floor(F.col("_last") / most))
    marked = placed.withColumn("_new", F.coalesce(fresh, F.lit(False)).cast("long"))
    marked = prefix_sum(marked, F.col("_new"), "_before", "offset", bin_bytes, 1, by_, ("size", "_new")).withColumn("range_group", F.col("_before") + F.col("_new"))
    marked = marked.drop("_reach", "_last", "_new", "_before")
    groups = marked.groupBy(*by_, "range_group").agg(F.min("offset").alias("group_start"), F.max(end).alias("group_end"))
    for x in by_:
        groups = groups.withColumnRenamed(x, f"_{x}_")
    same = [marked[x].eqNullSafe(F.col(f"_{x}_")) for x in by_]
    found = marked.join(groups.withColumnRenamed("range_group", "_group"), reduce(lambda a, b: a & b, same, marked["range_group"] == F.col("_group")))
    return found.drop("_group", *(f"_{x}_" for x in by_))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Bytes that two ranges share."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def priority_region(index: DataFrame) -> DataFrame:
    """The one range that holds all indexed payloads."""
    return index.agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("size")).alias("end"))
