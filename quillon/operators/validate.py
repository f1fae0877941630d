"""Validation as queries: every rule gives the rows that break it, as (code, name, detail), first by ord.

Rules on columns raise at once.  Rules on rows are filters, aggregations and joins, so they run over as many entries as there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.functions.expressions import byte_length, name_fault

FAULT = "code string, ord long, name string, detail string"


def faults(rows: DataFrame, code: str, detail: Column | str, name: str = "name", order: str = "ord") -> DataFrame:
    have = rows.columns
    return rows.select(
        F.lit(code).alias("code"),
        (F.col(order).cast("long") if order in have else F.lit(None).cast("long")).alias("ord"),
        (F.col(name).cast("string") if name in have else F.lit(None).cast("string")).alias("name"),
        (F.lit(detail) if isinstance(detail, str) else detail.cast("string")).alias("detail"),
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def raise_first(found: DataFrame) -> None:
    """Raise the first breach by ord and code; nothing where there is none."""
    row = found.orderBy(F.asc_nulls_last("ord"), "code", "detail").first()
    if row:
        raise ArchiveError(row["code"], f"{row['name']!r}: {row['detail']}" if row["name"] is not None else row["detail"])


# Columns -----------------------------------------------------------------------------------------------------------


def check_input_columns(table: DataFrame) -> None:
    if missing := sorted({"name", "path"} - set(table.columns)):
        raise ValueError(f"the input table lacks required column(s) {missing}")
    if reserved := sorted(set(c.RESERVED_COLUMNS) & set(table.columns)):
        raise ValueError(f"the input table has reserved column(s) {reserved}; they are computed")


def check_manifest_columns(names: list[str]) -> None:
    if "path" in names:
        raise ValueError("an embedded manifest may not have a column path")
    if missing := sorted({"name", "offset", "size"} - set(names)):
        raise ValueError(f"the manifest lacks required column(s) {missing}")


# Entries -----------------------------------------------------------------------------------------------------------


def duplicates(rows: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """The second and later rows of a name. Counts come first, so only names that repeat are sorted."""
    twice = rows.groupBy(name).count().where("count > 1").select(name)
    again = rows.join(twice, name, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy(name).orderBy(order)))
    return again.where("_n > 1").drop("_n")


def duplicate_faults(rows: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    return faults(duplicates(rows.where(F.col(name).isNotNull()), name, order), "DUPLICATE_NAME", "duplicate name", name, order)


def reserved_faults(rows: DataFrame, reserved: tuple[str, ...] = c.RESERVED_NAMES, name: str = "name") -> DataFrame:
    return faults(rows.where(F.col(name).isin(*reserved)), "INVALID_NAME", "reserved name", name)


def null_faults(rows: DataFrame, columns: tuple[str, ...] = ("name", "path")) -> DataFrame:
    return union(*(faults(rows.where(F.col(x).isNull()), "INVALID_NAME", f"null {x}") for x in columns))


def name_faults(rows: DataFrame, reserved: tuple[str, ...] = c.RESERVED_NAMES) -> DataFrame:
    """Names that break a rule of form, or are reserved."""
    fault = name_fault("name")
    own = rows.withColumn("_f", F.when((fault == "reserved") & ~F.col("name").isin(*reserved), None).otherwise(fault))
    return faults(own.where("_f is not null"), "INVALID_NAME", F.concat(F.lit("name: "), F.col("_f")))


def empty_faults(rows: DataFrame) -> DataFrame:
    return faults(rows.where(F.coalesce(F.col("size"), F.lit(0)) <= 0), "INVALID_ZIP_STRUCTURE", "zero-byte entry")


def zip32_faults(rows: DataFrame) -> DataFrame:
    """Payloads that an archive without ZIP64 cannot hold."""
    return faults(rows.where(F.col("size") >= c.SENTINEL32), "INVALID_ZIP64", F.col("size"))


def input_faults(rows: DataFrame) -> DataFrame:
    """Everything a flat archive's input rows may break before files are looked at."""
    n = rows.agg(F.count("*").alias("n")).where("n = 0")
    empty = faults(n, "INVALID_NAME", "the input table is empty")
    return union(null_faults(rows), name_faults(rows.where("name is not null")), duplicate_faults(rows), empty)


def entry_faults(rows: DataFrame, reserved: tuple[str, ...] = c.RESERVED_NAMES) -> DataFrame:
    return union(name_faults(rows, reserved), duplicate_faults(rows), empty_faults(rows))


def size_faults(rows: DataFrame, data: str = "data") -> DataFrame:
    """Buffers whose length is not the size they were planned with."""
    return faults(rows.where(F.col(data).isNotNull() & (F.octet_length(data) != F.col("size"))), "INVALID_OFFSET", "buffer length differs from size")


# Manifest against plan ---------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: str, chunk: int = 4096) -> DataFrame:
    """Adds ord 0, 1, ... in the order of a column, by counts of ranges of it."""
    from quillon.plans.layout import prefix_sum

    out = prefix_sum(rows.withColumn("_order", F.col(order)), F.lit(1), "_place", "_order", chunk)
    return out.drop("ord", "_order", order).withColumnRenamed("_place", "ord")


def positional_faults(planned: DataFrame, manifest: DataFrame, own: str = "ord") -> DataFrame:
    """Rows whose name, offset or size differ from the plan's of the same ord, nulls included, and rows that one side lacks.

    own: a column of the plan that names its rows in the result, if not ord; rows that the plan lacks are named by their ord.
    """
    fields = ("name", "offset", "size")
    a = planned.select("ord", *(F.col(x).cast("string").alias("a_" + x) for x in fields), F.col(own).alias("_own"), F.lit(True).alias("_a"))
    b = manifest.select("ord", *(F.col(x).cast("string").alias("b_" + x) for x in fields), F.lit(True).alias("_b"))
    both = a.join(b, "ord", "full_outer").withColumn("name", F.coalesce("a_name", "b_name")).withColumn("ord", F.coalesce("_own", "ord"))
    fault = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    lacks = F.col("_a").isNull() | F.col("_b").isNull()
    tests = [fault(lacks, "MISSING_ENTRY", F.when(F.col("_b").isNull(), "the manifest has fewer rows").otherwise("the manifest has more rows"))]
    code = {"name": "INVALID_NAME", "offset": "INVALID_OFFSET", "size": "INVALID_OFFSET"}
    for x in fields:
        said = F.concat(F.lit(f"{x} mismatch: planned "), F.coalesce("a_" + x, F.lit("null")), F.lit(", found "), F.coalesce("b_" + x, F.lit("null")))
        tests.append(fault(~lacks & ~F.col("a_" + x).eqNullSafe(F.col("b_" + x)), code[x], said))
    # One pass over the rows for all rules: the plan behind them is long.
    found = both.select("ord", "name", F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("t"))
    return found.select("t.code", F.col("ord").cast("long").alias("ord"), F.col("name").cast("string").alias("name"), "t.detail")


def row_count_faults(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    n = planned.agg(F.count("*").alias("planned")).withColumn("found", manifest.agg(F.count("*")).scalar())
    return faults(n.where("planned <> found"), "MISSING_ENTRY", F.concat(F.col("planned").cast("string"), F.lit(" rows planned, "), F.col("found").cast("string"), F.lit(" rows found")))


# Archives ----------------------------------------------------------------------------------------------------------


def directory_faults(records: DataFrame) -> DataFrame:
    """Breaches in a central directory: ord, name, flags, method, csize, usize."""
    flag = lambda bits: F.col("flags").bitwiseAND(F.lit(bits)) != 0
    wide = (F.octet_length("name") != F.char_length("name")) & ~flag(c.FLAG_UTF8)
    rules = [
        (F.col("method") != 0, "method is not STORE"),
        (flag(c.FLAG_ENCRYPTED | c.FLAG_STRONG | c.FLAG_MASKED), "encrypted"),
        (flag(c.FLAG_DESCRIPTOR), "data descriptor"),
        ((F.col("csize") != F.col("usize")) | (F.col("usize") <= 0), "sizes unequal or zero"),
        (F.col("name").endswith("/"), "directory entry"),
        (wide, "UTF-8 flag missing"),
    ]
    broken = F.filter(F.array(*(F.when(test, F.lit(text)) for test, text in rules)), lambda x: x.isNotNull())
    rows = records.withColumn("_f", F.explode(broken))
    names = name_faults(records, ()).where(F.col("detail") != "name: reserved")
    return union(faults(rows, "INVALID_ZIP_STRUCTURE", F.col("_f")), names, duplicate_faults(records))


def padding_faults(records: DataFrame, index: DataFrame) -> DataFrame:
    """More than one padding entry, or one in the index."""
    many = records.where(F.col("name") == c.PADDING_NAME)
    return union(faults(duplicates(many), "DUPLICATE_NAME", "second padding entry"), faults(index.where(F.col("name") == c.PADDING_NAME), "INVALID_NAME", "padding in the index"))


def index_faults(index: DataFrame, archive_size: int | None = None) -> DataFrame:
    """Breaches within an index relation (ord, name, offset, size)."""
    end = F.col("offset").cast("decimal(38,0)") + F.col("size").cast("decimal(38,0)")
    limit = F.lit(str(archive_size if archive_size is not None else 1 << 64)).cast("decimal(38,0)")
    bad = F.col("name").isNull() | (F.col("name") == "") | (F.col("name") == c.INDEX_NAME)
    return union(
        faults(index.where(bad), "INVALID_NAME", "name may not be in an index"),
        duplicate_faults(index),
        faults(index.where((F.col("size") <= 0) | (end > limit)), "INVALID_OFFSET", "range is empty or ends beyond the archive"),
    )


def missing_entry_faults(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Indexed names without an entry of that name, offset and size. entries: name, offset, size."""
    e = entries.select(F.col("name").alias("e_name"), F.col("offset").cast("decimal(20,0)").alias("e_offset"), F.col("size").cast("decimal(20,0)").alias("e_size"))
    joined = index.join(e, index["name"] == e["e_name"], "left")
    wrong = F.col("e_name").isNull() | (F.col("offset").cast("decimal(20,0)") != F.col("e_offset")) | (F.col("size").cast("decimal(20,0)") != F.col("e_size"))
    return faults(joined.where(wrong), "MISSING_ENTRY", F.when(F.col("e_name").isNull(), "no such entry").otherwise("offset or size differs"))


def completeness_faults(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Data entries that a flat manifest lacks, and rows of it without an entry."""
    data = entries.where(~F.col("name").isin(*c.RESERVED_NAMES))
    return union(
        faults(data.join(manifest.select("name"), "name", "left_anti"), "MISSING_ENTRY", "not in the manifest"),
        faults(manifest.join(data.select("name"), "name", "left_anti"), "MISSING_ENTRY", "in the manifest only"),
    )


def flat_index_faults(index: DataFrame) -> DataFrame:
    """A flat index holds the manifest and nothing else."""
    lacks = index.agg(F.count_if(F.col("name") == c.MANIFEST_NAME).alias("n")).where("n <> 1")
    return union(faults(index.where(F.col("name") != c.MANIFEST_NAME), "MISSING_ENTRY", "not allowed in a flat index"), faults(lacks, "MISSING_ENTRY", F.concat(F.col("n").cast("string"), F.lit(" manifests"))))


def priority_names(rows: DataFrame) -> Column:
    return (F.col("name") == c.COLLECTION_NAME) | (F.col("name").startswith(c.LEVEL_DIR) & F.col("name").endswith(".parquet"))


def hierarchy_index_faults(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Every priority file of a hierarchical archive is indexed, COLLECTION.json among them."""
    wanted = entries.where(priority_names(entries)).select("name")
    named = index.sparkSession.createDataFrame([(c.COLLECTION_NAME,)], "name string")
    return faults(wanted.union(named).distinct().join(index.select("name"), "name", "left_anti"), "MISSING_ENTRY", "priority file not in the index")


def contiguity_faults(entries: DataFrame, order: str = "lfh_offset") -> DataFrame:
    """Priority files end the archive as one block, padding before them: no other entry lies behind the first of them."""
    first = entries.where(priority_names(entries)).agg(F.min(order)).scalar()
    behind = entries.where(~priority_names(entries) & (F.col(order) > first))
    return faults(behind, "INVALID_ZIP_STRUCTURE", "behind the first priority file")


def gaps(entries: DataFrame) -> DataFrame:
    """Entries (lfh_offset, offset, size) that do not begin where the one before ends: adds expected. Each entry but the first has a predecessor that ends at its start, so this is a join."""
    ends = entries.select((F.col("offset") + F.col("size")).alias("_end"))
    start = entries.agg(F.min("lfh_offset")).scalar()
    return entries.join(ends, entries["lfh_offset"] == ends["_end"], "left_anti").where(F.col("lfh_offset") != start)


def order_faults(rows: DataFrame) -> DataFrame:
    """Null places in the order, and places that are taken twice."""
    return union(faults(rows.where(F.col("ord").isNull()), "INVALID_OFFSET", "null ord"), faults(duplicates(rows.where(F.col("ord").isNotNull()), "ord", "name"), "INVALID_OFFSET", "repeated ord"))


def increasing_faults(entries: DataFrame) -> DataFrame:
    """Offsets that do not exceed all that come before them by ord; places in chunks, so no task sees all rows."""
    from quillon.plans.layout import prefix

    before = prefix(entries, F.col("offset"), "_b", F.max)
    return faults(before.where(F.col("offset") <= F.col("_b")), "INVALID_OFFSET", "offset does not grow")


def long_name_faults(rows: DataFrame) -> DataFrame:
    return faults(rows.where(byte_length("name") > c.MAX_NAME), "INVALID_NAME", "name too long")
