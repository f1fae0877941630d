"""Queries over the driver's tables that exercise every operator, with the same queries in SQL for an independent engine.

documents are archive entries (name DATA/{doc_id}.txt, size in bytes, order doc_id), pages a second shard, orders and
lineitem samples and their children, events an ingest log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as c
from quillon.functions import expressions as x
from quillon.operators import hierarchy, names, ranges, validate
from quillon.plans import layout
from quillon.sources import reader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Where the archives and catalogs of the queries would lie.
ARCHIVE, CATALOG = "/data/ds.zip", "https://example.org/sets/INDEX.parquet"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("@index", c.INDEX_NAME).replace("@padding", c.PADDING_NAME).replace("@manifest", c.MANIFEST_NAME)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, *extras: str) -> DataFrame:
    """Documents as entries; sizes and extras without their texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("DATA/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), x.byte_length("text").alias("size"), (F.col("lang") == "en").alias("in_index"), *extras).where("size > 0")


ENTRIES = """
with e as (select doc_id as ord, 'DATA/' || cast(doc_id as varchar) || '.txt' as name, cast(strlen(text) as bigint) as size,
    lang = 'en' as in_index, lang, source, n_chars from documents where strlen(text) > 0),
s as (select *, 30 + strlen(name) + case when size >= 4294967295 then 20 else 0 end as lfh_size from e),
base as (select 51 + 11 + coalesce(sum(case when in_index then 18 + strlen(name) end), 0) as none_base from e),
flat as (select *, cast(92 + coalesce(sum(lfh_size + size) over (order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as lfh_offset from s),
none as (select s.*, cast(none_base + coalesce(sum(lfh_size + size) over (order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as lfh_offset from s, base)
"""


# Layout ------------------------------------------------------------------------------------------------------------


@query(ENTRIES + "select ord, name, lfh_offset, lfh_size, lfh_offset + lfh_size as \"offset\", size from flat")
def plan_flat_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_flat(entries(spark, sf_dir)).select("ord", "name", "lfh_offset", "lfh_size", "offset", "size")


@query(ENTRIES + "select ord, name, lfh_offset, lfh_size, lfh_offset + lfh_size as \"offset\", size from flat")
def plan_three_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_flat(entries(spark, sf_dir), levels=3, chunk=64).select("ord", "name", "lfh_offset", "lfh_size", "offset", "size")


@query(ENTRIES + "select ord, name, in_index, lfh_offset, lfh_size, lfh_offset + lfh_size as \"offset\", size from none")
def plan_in_index_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan(entries(spark, sf_dir)).select("ord", "name", "in_index", "lfh_offset", "lfh_size", "offset", "size")


@query(ENTRIES + """select cast(11 + sum(case when in_index then 18 + strlen(name) else 0 end) as bigint) as index_bytes,
    count(*) filter (in_index) as indexed, count(*) as total, cast(2 * count(*) filter (in_index) as bigint) as length_bytes,
    cast(coalesce(sum(strlen(name)) filter (in_index), 0) as bigint) as name_bytes, cast(8 * count(*) filter (in_index) as bigint) as offset_bytes,
    cast(8 * count(*) filter (in_index) as bigint) as size_bytes from e""")
def index_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if("in_index")
    names = F.coalesce(F.sum(F.when(F.col("in_index"), x.byte_length("name"))), F.lit(0))
    return entries(spark, sf_dir).agg(
        layout.index_payload_size(F.col("in_index")).alias("index_bytes"), n.alias("indexed"), F.count("*").alias("total"), (2 * n).alias("length_bytes"), names.alias("name_bytes"), (8 * n).alias("offset_bytes"), (8 * n).alias("size_bytes")
    )


@query(ENTRIES + """, g as (select lang, cast(92 + sum(lfh_size + size) + sum(46 + strlen(name)) + 55 + 22 as bigint) as predicted from s group by lang)
select lang, predicted, cast(case when predicted >= 32819 then 0 else greatest(32819 - predicted - 110, 1) end as bigint) as padding from g""")
def predicted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat archive per language: sizes and paddings as one aggregation."""
    e = entries(spark, sf_dir, "lang")
    size = (c.FLAT_BASE + F.sum(x.lfh_size("name", "size") + F.col("size")) + layout.directory_size() + c.EOCD_FIXED).cast("long")
    return e.groupBy("lang").agg(size.alias("predicted")).withColumn("padding", layout.padding_size("predicted"))


@query(ENTRIES + """, t as (select max(lfh_offset + lfh_size + size) as a, cast(sum(46 + strlen(name)) + 55 as bigint) as cd from flat)
select 'index header' as label, 'index-lfh' as kind, 0 as start, 51 as "end" union all select 'index', 'index', 51, 92
union all select name, 'file', lfh_offset, lfh_offset + lfh_size + size from flat
union all select 'central directory', 'cd', a, a + cd from t union all select 'end of central directory', 'eocd', a + cd, a + cd + 22 from t""")
def segments_bytemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.segments(layout.plan_flat(entries(spark, sf_dir)), c.FLAT_BASE - c.INDEX_LFH)


LOOKUP = ENTRIES + """, q as (select doc_id as id, (doc_id * 7919) % (select max(lfh_offset + lfh_size + size) from flat) as place from documents)
select id, place, name, lfh_offset as start, lfh_offset + lfh_size + size as "end" from q join flat on lfh_offset <= place and place < lfh_offset + lfh_size + size"""


def _lookup(spark: SparkSession, sf_dir: str, how: Callable) -> DataFrame:
    plan = layout.plan_flat(entries(spark, sf_dir)).select("name", F.col("lfh_offset").alias("start"), (F.col("offset") + F.col("size")).alias("end"))
    last = plan.agg(F.max("end")).scalar()
    points = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % last).alias("place"))
    return how(points, plan, "place").select("id", "place", "name", "start", "end")


@query(LOOKUP)
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, ranges.locate)


@query(LOOKUP)
def segment_lookup_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, ranges.locate_asof)


# Paths and manifests -----------------------------------------------------------------------------------------------


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_flat(entries(spark, sf_dir, "lang", "source", "n_chars")).select("name", "offset", "size", "lang", "source", "n_chars")


MANIFEST = ENTRIES + ", m as (select name, lfh_offset + lfh_size as \"offset\", size, lang, source, n_chars from flat)"


@query(MANIFEST + " select name, '/vsisubfile/' || \"offset\" || '_' || size || ',/data/ds.zip' as vsi from m")
def vsi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.with_vsi(manifest(spark, sf_dir), F.lit(x.vsi_base(ARCHIVE))).select("name", F.col(f"`{c.VSI_COLUMN}`").alias("vsi"))


@query(MANIFEST + """ select source || '.zip' as shard, name, '/vsisubfile/' || "offset" || '_' || size || ',/vsicurl/https://example.org/sets/' || source || '.zip' as vsi from m""")
def vsi_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = manifest(spark, sf_dir).withColumn("shard", F.concat("source", F.lit(".zip")))
    return reader.with_vsi(catalog, F.concat(F.lit(x.vsi_base_dir(CATALOG)), F.col("shard"))).select("shard", "name", F.col(f"`{c.VSI_COLUMN}`").alias("vsi"))


@query("""select page_id, case when url like 'http%' then '/vsicurl/' || url else url end as store,
  regexp_extract(url, '([^/]*)$', 1) as base from pages""")
def vsi_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", x.vsi_store("url").alias("store"), x.basename("url").alias("base"))


@query(MANIFEST + " select name, \"offset\", size, lang from m where name like '%7.txt' and lang = 'en' order by size desc, name limit 5")
def manifest_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).where("name like '%7.txt' and lang = 'en'").select("name", "offset", "size", "lang").orderBy(F.desc("size"), "name").limit(5)


@query(MANIFEST + " select name, \"offset\", size from m order by \"offset\" limit 10")
def manifest_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("name", "offset", "size").orderBy("offset").limit(10)


@query(MANIFEST + " select name, n_chars, size from m where n_chars between 500 and 2000 and source = 'src0'")
def manifest_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).where("n_chars between 500 and 2000 and source = 'src0'").select("name", "n_chars", "size")


@query(MANIFEST + " select name, lang from m where lang = 'en' order by md5(name || '7'), name limit 32")
def manifest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 32: order by a hash, so that it is the same each time."""
    return manifest(spark, sf_dir).where("lang = 'en'").orderBy(F.md5(F.concat("name", F.lit("7"))), "name").limit(32).select("name", "lang")


@query(MANIFEST + " select name, \"offset\", size from m where name = 'DATA/5.txt'")
def manifest_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).where("name = 'DATA/5.txt'").select("name", "offset", "size")


@query(MANIFEST + " select source, lang, count(*) as entries, cast(sum(size) as bigint) as bytes, max(size) as largest from m group by source, lang")
def manifest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


@query(MANIFEST + ", l as (select 'DATA/' || cast(doc_id as varchar) || '.txt' as name, quality, toxic from labels) select m.name, size, quality, toxic from m join l on m.name = l.name")
def manifest_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("DATA/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "quality", "toxic")
    return manifest(spark, sf_dir).select("name", "size").join(labels, "name")


@query(ENTRIES + "select min(lfh_offset + lfh_size) as start, max(lfh_offset + lfh_size + size) as \"end\" from none where in_index")
def priority_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.priority_region(layout.plan(entries(spark, sf_dir)).where("in_index"))


@query(ENTRIES + """, r as (select source, lfh_offset + lfh_size as "offset", size from flat where in_index),
b as (select *, max("offset" + size) over (partition by source order by "offset", size rows between unbounded preceding and 1 preceding) as reach from r),
n as (select *, cast(sum(case when "offset" > reach + 20000 then 1 else 0 end) over (partition by source order by "offset", size rows unbounded preceding) as bigint) as range_group from b)
select source, "offset", size, range_group, min("offset") over (partition by source, range_group) as group_start, max("offset" + size) over (partition by source, range_group) as group_end from n""")
def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = layout.plan_flat(entries(spark, sf_dir, "source")).where("in_index").select("source", "offset", "size")
    return ranges.coalesced(plan, 20_000, ["source"])


@query(ENTRIES + """, z as (select max(lfh_offset + lfh_size + size) + 1000 as whole, 92 + max(ord) as i from flat)
select whole, greatest(least(51 + i, whole) - greatest(51, whole - 32768), 0) as shared from z""")
def hash_regions_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = layout.plan_flat(entries(spark, sf_dir)).agg((F.max(F.col("offset") + F.col("size")) + 1000).alias("whole"), (92 + F.max("ord")).alias("i"))
    return z.select("whole", ranges.overlap(F.lit(c.INDEX_LFH), c.INDEX_LFH + F.col("i"), F.col("whole") - c.HASH_WINDOW, F.col("whole")).alias("shared"))


# Validation --------------------------------------------------------------------------------------------------------


def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from documents so that every rule is broken by some."""
    k = F.col("doc_id") % 12
    name = F.concat(F.lit("DATA/"), F.floor(F.col("doc_id") / 3).cast("string"))
    name = (
        F.when(k == 1, F.concat(F.lit("/"), name)).when(k == 2, F.concat(F.lit("C:"), name)).when(k == 3, F.concat(name, F.lit("/../x"))).when(k == 4, F.lit("")).when(k == 5, F.lit(c.INDEX_NAME))
        .when(k == 6, F.concat(name, F.lit("\\y"))).when(k == 7, F.lit(None)).when(k == 8, F.concat(F.lit("é/"), name)).otherwise(name)
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), name.alias("name"), F.lit("p").alias("path"), x.byte_length("text").alias("size"))


ODD = r"""with o as (select doc_id as ord, case doc_id % 12 when 1 then '/' || n when 2 then 'C:' || n when 3 then n || '/../x' when 4 then '' when 5 then '@index'
  when 6 then n || '\y' when 7 then null when 8 then 'é/' || n else n end as name from (select doc_id, 'DATA/' || cast(doc_id // 3 as varchar) as n from documents))"""


@query(ODD + r""" select ord, name, case when name is null or name = '' then 'empty' when name like '/%' then 'leading slash' when regexp_matches(name, '^[A-Za-z]:') then 'drive letter'
  when contains(name, '\') then 'backslash' when regexp_matches(name, '(^|/)\.\.?(/|$)') then 'dot component' when name = '@index' then 'reserved' end as fault from o
  where name is null or name = '' or name like '/%' or regexp_matches(name, '^[A-Za-z]:') or contains(name, '\') or regexp_matches(name, '(^|/)\.\.?(/|$)') or name = '@index'""")
def validate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.name_faults(odd_names(spark, sf_dir))
    return found.select("ord", "name", F.substr("detail", F.lit(7)).alias("fault"))


@query(ODD + " select ord, name from (select *, row_number() over (partition by name order by ord) as n from o where name is not null) where n > 1")
def validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_faults(odd_names(spark, sf_dir)).select("ord", "name")


@query(ODD + " select ord, name, 'reserved name' as detail from o where name in ('@index', '@padding', '@manifest')")
def validate_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reserved_faults(odd_names(spark, sf_dir)).select("ord", "name", "detail")


@query(ODD + " select ord, 'null name' as detail from o where name is null")
def validate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.null_faults(odd_names(spark, sf_dir)).select("ord", "detail")


def damaged_manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A plan, and a manifest that differs from it in a third of the rows and ends early."""
    plan = layout.plan_flat(entries(spark, sf_dir)).select("ord", "name", "offset", "size")
    k = F.col("ord") % 9
    bad = plan.where(k != 8).select(
        "ord", F.when(k == 1, F.lit("other")).when(k == 2, F.lit(None)).otherwise(F.col("name")).alias("name"), (F.col("offset") + F.when(k == 3, 1).otherwise(0)).alias("offset"), F.when(k == 4, F.lit(None)).otherwise(F.col("size")).alias("size")
    )
    return plan, bad


@query(ENTRIES + """select ord, 'INVALID_NAME' as code from flat where ord % 9 in (1, 2) union all select ord, 'INVALID_OFFSET' from flat where ord % 9 in (3, 4)
  union all select ord, 'MISSING_ENTRY' from flat where ord % 9 = 8""")
def validate_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.positional_faults(*damaged_manifest(spark, sf_dir)).select("ord", "code")


@query(ENTRIES + "select count(*) || ' rows planned, ' || count(*) filter (ord % 9 <> 8) || ' rows found' as detail from flat having count(*) filter (ord % 9 = 8) > 0")
def validate_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.row_count_faults(*damaged_manifest(spark, sf_dir)).select("detail")


@query(ENTRIES + "select name, case when ord % 5 = 0 then 'no such entry' else 'offset or size differs' end as detail from none where in_index and ord % 5 in (0, 1)")
def validate_missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = layout.plan(entries(spark, sf_dir))
    index = plan.where("in_index").select("ord", "name", "offset", "size")
    there = plan.where("ord % 5 <> 0").select("name", (F.col("offset") + F.when(F.col("ord") % 5 == 1, 3).otherwise(0)).alias("offset"), "size")
    return validate.missing_entry_faults(index, there).select("name", "detail")


@query(ENTRIES + """, l as (select 'DATA/' || cast(doc_id as varchar) || '.txt' as name from labels union all select 'DATA/none')
select name, 'not in the manifest' as detail from e where name not in (select name from l) union all select name, 'in the manifest only' from l where name not in (select name from e)""")
def validate_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "labels").select(F.concat(F.lit("DATA/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")).union(spark.sql("select 'DATA/none'"))
    return validate.completeness_faults(listed, entries(spark, sf_dir)).select("name", "detail")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory records made from documents, some of which break a rule."""
    k = F.col("doc_id") % 11
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.when(k == 1, F.concat(F.lit("é"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(k == 2, "/").otherwise(""))).alias("name"),
        F.when(k == 3, 8).when(k == 4, 1).when(k == 5, 2048).otherwise(0).alias("flags"), F.when(k == 6, 8).otherwise(0).alias("method"), F.col("n_chars").alias("csize"), (F.col("n_chars") + F.when(k == 7, 1).otherwise(0)).alias("usize"),
    )


@query("""with r as (select doc_id as ord, doc_id % 11 as k, n_chars from documents) select ord, 'UTF-8 flag missing' as detail from r where k = 1 union all select ord, 'directory entry' from r where k = 2
  union all select ord, 'data descriptor' from r where k = 3 union all select ord, 'encrypted' from r where k = 4 union all select ord, 'method is not STORE' from r where k = 6 union all select ord, 'sizes unequal or zero' from r where k = 7 or n_chars = 0""")
def validate_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.directory_faults(records(spark, sf_dir)).where("code = 'INVALID_ZIP_STRUCTURE'").select("ord", "detail")


@query(ENTRIES + "select ord, name from flat where ord % 7 = 0 and ord > 0")
def validate_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh entry is moved: it no longer begins where the one before ends."""
    plan = layout.plan_flat(entries(spark, sf_dir)).withColumn("lfh_offset", F.col("lfh_offset") + F.when((F.col("ord") % 7 == 0) & (F.col("ord") > 0), 1).otherwise(0))
    return validate.gaps(plan).select("ord", "name")


@query(ENTRIES + """, h as (select case when ord % 100 = 50 then 'METADATA/' || ord || '.parquet' when ord = 30 then 'COLLECTION.json' else name end as name, ord, lfh_offset from flat)
select ord, name, 'behind the first priority file' as detail from h where name like 'DATA/%' and lfh_offset > (select min(lfh_offset) from h where name not like 'DATA/%')""")
def validate_priority_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("ord") % 100 == 50, F.concat(F.lit(c.LEVEL_DIR), F.col("ord").cast("string"), F.lit(".parquet"))).when(F.col("ord") == 30, c.COLLECTION_NAME).otherwise(F.col("name"))
    return validate.contiguity_faults(layout.plan_flat(entries(spark, sf_dir)).withColumn("name", name)).select("ord", "name", "detail")


@query(ENTRIES + """, i as (select ord, name, (lfh_offset + lfh_size)::hugeint + case when ord % 6 = 1 then 18446744073709551000::hugeint else 0 end as o, size from none where in_index)
select ord, 'range is empty or ends beyond the archive' as detail from i where o + size > 18446744073709551616::hugeint""")
def validate_index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.lit("18446744073709551000").cast("decimal(20,0)")
    index = layout.plan(entries(spark, sf_dir)).where("in_index").select("ord", "name", (F.col("offset").cast("decimal(20,0)") + F.when(F.col("ord") % 6 == 1, far).otherwise(F.lit(0).cast("decimal(20,0)"))).alias("offset"), "size")
    return validate.index_faults(index).select("ord", "detail")


@query("select doc_id as ord, 'buffer length differs from size' as detail from documents where doc_id % 4 = 1")
def validate_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("data"), (x.byte_length("text") + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).alias("size"))
    return validate.size_faults(rows).select("ord", "detail")


# Expressions -------------------------------------------------------------------------------------------------------


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    n = F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("C:\\x\\"), n)).when(k == 1, F.concat(F.lit("//a/./"), n, F.lit("/.."))).when(k == 2, F.lit(" / .. /")).when(k == 3, F.concat(F.lit("q/ "), n, F.lit(" /z.tif"))).when(k == 4, F.lit(c.INDEX_NAME)).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


RAW = r"""with r as (select p_partkey, case p_partkey % 6 when 0 then 'C:\x\' || p_name when 1 then '//a/./' || p_name || '/..' when 2 then ' / .. /' when 3 then 'q/ ' || p_name || ' /z.tif' when 4 then '@index' else p_name end as raw from part),
k as (select p_partkey, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(replace(raw, '\', '/')), '^[A-Za-z]:+', ''), '^/+', ''), '/'), lambda p: trim(p)), lambda p: p not in ('', '.', '..')), '/') as n from r),
cl as (select p_partkey, case when n = '' then 'payload.bin' when n in ('@index', '@padding') then 'payload/' || n || '.bin' else n end as clean from k)"""


@query(RAW + " select p_partkey, clean, replace(clean, '/', '-') as download from cl")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_names(spark, sf_dir).select("p_partkey", x.clean_name("raw").alias("clean"), x.download_name("raw").alias("download"))


@query("""with u as (select p_partkey, p_type || '.v1.tif' as name from part), n as (select *, row_number() over (partition by name order by p_partkey) as k from u)
select p_partkey, case when k = 1 then name else regexp_replace(name, '\\.tif$', '-' || k || '.tif') end as name from n""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(".v1.tif")).alias("name"))
    return names.unique_names(rows, "name", "p_partkey").select("p_partkey", F.col("unique_name").alias("name"))


@query("""select doc_id, case when b < 1024 then b || ' B' else printf(case when v >= 10 then '%.1f ' else '%.2f ' end || unit, case when v >= 10 then floor(v * 10 + 0.5) / 10 else floor(v * 100 + 0.5) / 100 end) end as said
  from (select *, b / case unit when 'KiB' then 1024.0 when 'MiB' then 1048576.0 else 1073741824.0 end::double as v from (select *, case when b < 1048576 then 'KiB' when b < 1073741824 then 'MiB' else 'GiB' end as unit
  from (select doc_id, strlen(text) * case doc_id % 3 when 0 then 1 when 1 then 1000 else 10000000 end as b from documents)))""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    b = x.byte_length("text") * F.when(k == 0, 1).when(k == 1, 1000).otherwise(10_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("b")).select("doc_id", x.human_bytes("b").alias("said"))


@query("""select o_orderkey, upper(lpad(to_hex((o_orderkey & 255) * 256 + ((o_orderkey >> 8) & 255)), 4, '0')) as u16, '0x' || lower(lpad(to_hex(o_orderkey * 1000003), 16, '0')) as hex64,
  upper(array_to_string(list_transform(range(0, 8), lambda i: lpad(to_hex(((o_orderkey * 1000003) >> (8 * i)::int) & 255), 2, '0')), '')) as u64, o_orderkey * 1000003 as back from orders""")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderkey") * 1000003
    return table(spark, sf_dir, "orders").select("o_orderkey", x.le_hex(F.col("o_orderkey").bitwiseAND(F.lit(65535)), 2).alias("u16"), x.hex64(v).alias("hex64"), x.le_hex(v, 8).alias("u64"), x.le_value(x.le_bytes(v, 8), 0, 8).cast("long").alias("back"))


@query("""select p_partkey, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, strlen(p_name) + 1), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i - 1, 2))::int::uhugeint)),
  lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint), 16, '0')) as fnv from part""")
def fnv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", x.fnv1a64("p_name").alias("fnv"))


def _le(v: str, n: int) -> str:
    return f"upper(array_to_string(list_transform(range(0, {n}), lambda i: lpad(to_hex(({v} >> (8 * i)::int) & 255), 2, '0')), ''))"


@query(ENTRIES + f"select ord, '504B030414000000' || '0000' || '0000' || '2100' || '00000000' || {_le('size', 4)} || {_le('size', 4)} || {_le('strlen(name)', 2)} || '0000' || hex(encode(name)) as header from e")
def local_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("ord", x.local_header_hex("name", "size").alias("header"))


@query(ENTRIES + f"select ord, '504B01021400140000000000' || '0000' || '2100' || '00000000' || {_le('size', 4)} || {_le('size', 4)} || {_le('strlen(name)', 2)} || '0000000000000000' || '00000000' || {_le('lfh_offset', 4)} || hex(encode(name)) as record, '0CCA08000000000000000000' as extra from flat")
def directory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_flat(entries(spark, sf_dir)).select("ord", x.directory_record_hex("name", "size", "lfh_offset").alias("record"), x.index_extra_hex().alias("extra"))


@query("""select o_orderkey, cast((year(o_orderdate) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate) as int) as d, cast(hour(o_orderdate) * 2048 + minute(o_orderdate) * 32 + second(o_orderdate) // 2 as int) as t, date_trunc('day', o_orderdate) as day from orders""")
def dos_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = x.dos_date("o_orderdate"), x.dos_time("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), t.alias("t"), F.date_trunc("day", x.from_dos(d, t)).alias("day"))


@query("""select doc_id, case doc_id % 103 when 0 then 'OK' when 1 then 'INVALID_LFH' when 2 then 'ARCHIVE_TOO_SMALL' when 100 then 'INVALID_ARGUMENT' when 101 then 'BUFFER_TOO_SMALL' when 102 then 'IO' else 'UNKNOWN' end as status,
  case doc_id % 4 when 0 then 'none' when 1 then 'flat' when 2 then 'levels' else 'reserved' end as profile from documents""")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", x.status_name(F.col("doc_id") % 103).alias("status"), x.profile_name(F.col("doc_id") % 4).alias("profile"))


# Hierarchy ---------------------------------------------------------------------------------------------------------


def levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    leaf = F.concat(F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("B0"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("img"), F.col("l_linenumber").cast("string"))), F.lit(".tif"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), leaf.alias("name"), F.col("l_partkey").alias("offset"), F.col("l_quantity").cast("long").alias("size"), "l_linenumber")
    return samples, files


LEVELS = """with samples as (select o_orderkey as id, o_orderstatus, o_totalprice from orders), files as (select l_orderkey as parent_id,
  case when l_linenumber <= 2 then 'B0' || l_linenumber else 'img' || l_linenumber end || '.tif' as name, l_partkey as "offset", cast(l_quantity as bigint) as size, l_linenumber from lineitem)"""


@query(LEVELS + " select id, o_orderstatus, name, 'DATA/' || id || '/' || name as path, 'sample__before.parquet' as level_file from samples join files on id = parent_id")
def hierarchy_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, files = levels(spark, sf_dir)
    rows = hierarchy.children(samples, files)
    return rows.select("id", "o_orderstatus", "name", x.data_path("id", "name").alias("path"), x.level_file(F.lit("sample/before")).alias("level_file"))


@query(LEVELS + """, v as (select parent_id, name, '/vsisubfile/' || min("offset") || '_' || min(size) || ',/data/ds.zip' as vsi from files group by parent_id, name)
select parent_id, max(case when name = 'B01.tif' then vsi end) as b01, max(case when name = 'B02.tif' then vsi end) as b02, max(case when name = 'img3.tif' then vsi end) as img3 from v group by parent_id""")
def hierarchy_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = levels(spark, sf_dir)
    rows = files.groupBy("parent_id", "name").agg(F.min("offset").alias("offset"), F.min("size").alias("size")).withColumn("vsi", x.vsi_path("offset", "size", F.lit(ARCHIVE)))
    w = hierarchy.wide(rows, "parent_id", "name", "vsi", ["B01.tif", "B02.tif", "img3.tif"])
    return w.select("parent_id", *(F.col(f"`{a}`").alias(b) for a, b in (("B01.tif", "b01"), ("B02.tif", "b02"), ("img3.tif", "img3"))))


@query(LEVELS + " select parent_id, name, size from files where parent_id >= 10 and parent_id < 20")
def sample_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir)[1].where("parent_id >= 10 and parent_id < 20").select("parent_id", "name", "size")


@query(LEVELS + """, n as (select parent_id, count(*) filter (name = 'B01.tif') as a, count(*) filter (name like 'img%.tif') as b from files group by parent_id),
j as (select id, coalesce(a, 0) as a, coalesce(b, 0) as b from samples left join n on id = parent_id)
select id as sample, 'B01.tif' as rule, cast(a as varchar) as found from j where a <> 1 union all select id, 'img*[1,3].tif', cast(b as varchar) from j where b not between 1 and 3""")
def contract_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, files = levels(spark, sf_dir)
    return hierarchy.contract_faults(samples, files, ["B01.tif", "img*[1,3].tif"])


@query("select doc_id as id, lang, null as url, 'documents' as dataset from documents union all select page_id, null, url, 'pages' from pages")
def level_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return hierarchy.union_datasets({"documents": docs, "pages": pages})


@query("select event_id, json_extract_string(props, '$.page') as page, json_extract_string(props, '$.k') as k from events")
def collection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("select date_trunc('day', ts) as start, count(*) as entries, cast(sum(length(event_type)) as bigint) as bytes from events group by 1")
def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.streaming.discovery import ingest_counts

    return ingest_counts(table(spark, sf_dir, "events").select("ts", F.length("event_type").alias("size")), "1 day")


@query(ENTRIES + """select cast(max(lfh_offset + lfh_size + size) + sum(46 + strlen(name)) + 55 + 22 as bigint) as archive_bytes, cast(41 as bigint) as index_bytes, count(*) as entries,
  '11 + (1 * 18) + 12 name bytes = 41 bytes' as formula from flat""")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.lit(c.FLAT_BASE - c.INDEX_LFH).cast("long")
    formula = F.concat(F.lit(f"{c.INDEX_HEADER} + (1 * {c.INDEX_ENTRY}) + {len(c.MANIFEST_NAME)} name bytes = "), size.cast("string"), F.lit(" bytes"))
    return layout.plan_flat(entries(spark, sf_dir)).agg(layout.predicted_size(size).alias("archive_bytes"), F.first(size).alias("index_bytes"), F.count("*").alias("entries"), F.first(formula).alias("formula"))


# Archives written and read -----------------------------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A flat archive of all documents, written anew in a folder of its own."""
    import atexit
    import shutil
    import tempfile

    from quillon.sources import writer

    folder = tempfile.mkdtemp(prefix="quillon-archive-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    rows = writer.entries_of(table(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select(F.col("doc_id").alias("ord"), F.concat(F.lit("DATA/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("b"), "lang"), "b")
    plan = layout.plan_flat(rows.drop("data", "b"))
    data = writer.manifest_bytes(plan.select("ord", "name", F.col("offset").cast("decimal(20,0)").alias("offset"), F.col("size").cast("decimal(20,0)").alias("size"), "lang"))
    return writer.write_archive(rows, f"{folder}/documents.zip", "flat", data)


@query(ENTRIES + "select name, lfh_offset + lfh_size as \"offset\", size, lang from flat")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive of all documents and read its manifest back."""
    df = reader.read(spark, _written(spark, sf_dir), gdal_vsi=False)
    return df.select("name", F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"), "lang")


@query("select 'DATA/' || cast(doc_id as varchar) || '.txt' as name, md5(text) as digest from documents where strlen(text) > 0")
def archive_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive and read every payload back by coalesced byte ranges."""
    from quillon.sources import io

    path = _written(spark, sf_dir)
    df = reader.read(spark, path, gdal_vsi=False).select("name", F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))
    return io.with_payloads(df, path).select("name", F.md5("payload").alias("digest"))


@query(ENTRIES + "select name, 0 as flags, 0 as method, size as usize, lfh_offset, lfh_offset + lfh_size as \"offset\" from flat")
def archive_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive and scan its central directory through the data source."""
    from quillon.sources import datasource

    datasource.register(spark)
    df = spark.read.format("quillon").option("view", "central_directory").load(_written(spark, sf_dir))
    return df.where(~F.col("name").isin(*c.RESERVED_NAMES)).select("name", "flags", "method", "usize", "lfh_offset", "offset")


def _all() -> None:
    from quillon import archive_queries  # noqa: F401  registers its own


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
