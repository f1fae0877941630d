"""More queries over the driver's tables: staging, whole archives, damaged relations and records, each with the same in SQL.

Items of benchmark are files of their own here (B/{item_id}.txt), documents and orders entries, parts names and bytes.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import codec
from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.functions import expressions as x
from quillon.operators import hierarchy, names, validate
from quillon.plans import layout
from quillon.queries import ENTRIES, LEVELS, entries, levels, query, records, table
from quillon.sources import datasource, io, reader, tablefunctions, writer
from quillon.sources.store import remove, resolved, scratch

FILES = """
with b as (select item_id as ord, 'B/' || cast(item_id as varchar) || '.txt' as name, cast(strlen(text) as bigint) as size, cast(length(text) as bigint) as chars, text from benchmark where strlen(text) > 0),
flat as (select *, cast(92 + coalesce(sum(30 + strlen(name) + size) over (order by ord rows between unbounded preceding and 1 preceding), 0) + 30 + strlen(name) as bigint) as "offset" from b)
"""


def _folder(spark: SparkSession) -> str:
    """A folder of the query's own that all machines share; it goes when the driver ends."""
    path = f"{scratch(spark)}/query-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    store, place = resolved(path)
    store.create_dir(place, recursive=True)
    return path


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items written as files by the executors: ord, name, path, chars."""
    folder = _folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = resolved(folder)
        for batch in batches:
            paths = []
            for k, text in zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist(), strict=True):
                with store.open_output_stream(f"{place}/{k}.txt", compression=None) as out:
                    out.write(text.encode())
                paths.append(f"{folder}/{k}.txt")
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("name"), pa.array(paths, pa.string()), batch.column("chars")], names=["ord", "name", "path", "chars"])

    rows = table(spark, sf_dir, "benchmark").where(F.octet_length("text") > 0)
    rows = rows.select(F.col("item_id").alias("ord"), F.concat(F.lit("B/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), "text", F.char_length("text").cast("long").alias("chars"))
    return _table(rows.mapInArrow(run, "ord long, name string, path string, chars long"), f"{folder}/table")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as entries with their bytes."""
    rows = table(spark, sf_dir, "benchmark").where(F.octet_length("text") > 0)
    return writer.entries_of(rows.select(F.col("item_id").alias("ord"), F.concat(F.lit("B/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("b")), "b").drop("b")


def whole(df: DataFrame) -> DataFrame:
    """Offsets and sizes as longs."""
    return df.withColumns({n: F.col(n).cast("long") for n in ("offset", "size") if n in df.columns})


def decoded(rows: DataFrame, schema: str, one) -> DataFrame:
    """A row of results for each row (k, data), or the code of its error."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, data in zip(batch.column("k").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    out.append({"k": k, **one(data)})
                except ArchiveError as e:
                    out.append({"k": k, "code": e.code})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in schema.split(", "))])
    assert fields[0] == "k"
    return rows.select("k", "data").mapInArrow(run, schema)


# Staging and whole archives ----------------------------------------------------------------------------------------


@query(FILES + 'select name, "offset", size, chars from flat')
def stage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(writer.stage_metadata(files(spark, sf_dir))[0]).select("name", "offset", "size", "chars")


@query(FILES + """, r as (select ord, name, size, (select max(ord) from b) - ord as place from b), p as (select *, cast(92 + coalesce(sum(30 + strlen(name) + size) over (order by place rows between unbounded preceding and 1 preceding), 0) + 30 + strlen(name) as bigint) as "offset" from r)
select place as ord, p.name, 'B/' || ord || '.txt' as file, "offset" from p""")
def stage_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's order, here back to front, holds for the manifest and for the paths."""
    rows = files(spark, sf_dir)
    last = rows.agg(F.max("ord")).first()[0]
    manifest, paths = writer.stage_metadata(rows.withColumn("ord", F.lit(last) - F.col("ord")))
    file = F.concat(F.lit("B/"), x.basename("path"))
    return whole(manifest).select("ord", "offset").join(paths.select("ord", "name", file.alias("file")), "ord").select("ord", "name", "file", "offset")


@query(FILES + 'select name, "offset", size, chars from flat')
def create_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writer.create(f"{_folder(spark)}/ds.zip", files(spark, sf_dir))
    return whole(reader.read(spark, path, gdal_vsi=False)).select("name", "offset", "size", "chars")


@query(FILES + 'select name, "offset", size, chars from flat')
def read_archive_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function."""
    tablefunctions.register(spark)
    path = writer.create(f"{_folder(spark)}/ds.zip", files(spark, sf_dir))
    return whole(spark.sql(f"select * from read_archive('{path}', false)")).select("name", "offset", "size", "chars")


@query(FILES + """select name, '/vsisubfile/' || "offset" || '_' || size as range, 'ds.zip' as archive from flat""")
def manifest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view on the data source: one task for each row group of the manifest, with virtual paths."""
    datasource.register(spark)
    path = writer.create(f"{_folder(spark)}/ds.zip", files(spark, sf_dir))
    spark.sql(f"create or replace temporary view quillon_manifest using quillon options (path '{path}', view 'manifest')")
    vsi = F.col(f"`{c.VSI_COLUMN}`")
    return spark.table("quillon_manifest").select("name", F.substring_index(vsi, ",", 1).alias("range"), x.basename(vsi).alias("archive"))


@query("""select 'geo' as key, '{"version": "1.0.0", "columns": {}}' as value union all select 'origin', 'benchmark'""")
def manifest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value metadata of an embedded manifest, geometry's among it, after writing and reading the archive."""
    path = writer.create(f"{_folder(spark)}/ds.zip", files(spark, sf_dir), {"geo": '{"version": "1.0.0", "columns": {}}', "origin": "benchmark"})
    found = tablefunctions.embedded(path).schema_arrow.metadata
    return spark.createDataFrame([(k.decode(), v.decode()) for k, v in found.items() if k in (b"geo", b"origin")], "key string, value string")


@query(FILES + """select ord, 'INVALID_OFFSET' as code from flat where ord % 7 in (1, 3) union all select ord, 'INVALID_NAME' from flat where ord % 7 = 2 union all select ord, 'MISSING_ENTRY' from flat where ord = (select max(ord) from b)""")
def stage_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests' files that differ from the plan: one has moved, renamed and resized entries, the last one's among them, the other lacks that one."""
    manifest, paths = writer.stage_metadata(files(spark, sf_dir))
    k, last = F.col("ord") % 7, manifest.agg(F.max("ord")).first()[0]
    changed = manifest.withColumns({"offset": F.col("offset") + F.when(k == 1, 1).otherwise(0), "name": F.when(k == 2, "other").otherwise(F.col("name")), "size": F.col("size") + F.when(k == 3, 1).otherwise(0)})
    found = []
    for name, bad in (("changed", changed), ("short", manifest.where(F.col("ord") != last))):
        for n in c.RESERVED_COLUMNS:
            bad = bad.withColumn(n, F.col(n).cast("decimal(20,0)"))
        found.append(writer.stage_faults(paths, writer.write_manifest(bad, f"{_folder(spark)}/{name}.parquet")))
    return found[0].unionByName(found[1]).select("ord", "code")


@query(FILES + 'select name, "offset", size, md5(text) as digest from flat')
def stage_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's Parquet file is embedded unchanged; payloads come back by virtual ranges."""
    folder = _folder(spark)
    manifest, paths = writer.stage_metadata(files(spark, sf_dir))
    path = writer.stage_create(f"{folder}/ds.zip", paths, writer.write_manifest(manifest, f"{folder}/m.parquet"))
    return io.with_payloads(whole(reader.read(spark, path, gdal_vsi=False)), path).select("name", "offset", "size", F.md5("payload").alias("digest"))


@query(FILES + "select name, md5(text) as digest, size from b")
def whole_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file read whole by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for path in batch.column("path").to_pylist():
                source = io.Source(path)
                data.append(source.all())
                source.close()
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(data, pa.binary())], names=["name", "data"])

    rows = files(spark, sf_dir).select("name", "path").mapInArrow(run, "name string, data binary")
    return rows.select("name", F.md5("data").alias("digest"), x.byte_length("data").alias("size"))


INDEXED = FILES + """, i as (select *, ord % 3 = 0 as in_index from b), base as (select 51 + 11 + sum(case when in_index then 18 + strlen(name) else 0 end) as begins from i),
p as (select i.*, cast(begins + coalesce(sum(30 + strlen(name) + size) over (order by ord rows between unbounded preceding and 1 preceding), 0) + 30 + strlen(name) as bigint) as "offset" from i, base)"""


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    return writer.write_archive(items(spark, sf_dir).withColumn("in_index", F.col("ord") % 3 == 0), f"{_folder(spark)}/none.zip")


@query(INDEXED + ' select cast(row_number() over (order by ord) - 1 as int) as ord, name, "offset", size from p where in_index')
def none_archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive without a profile: a third of its entries are in the index, which is read back."""
    datasource.register(spark)
    return whole(spark.read.format("quillon").option("view", "index").load(_indexed(spark, sf_dir)))


@query(INDEXED + " select name, size, md5(text) as digest from p where in_index")
def priority_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indexed payloads by one request, cut apart."""
    found = reader.priority_files(_indexed(spark, sf_dir))
    return spark.createDataFrame([(n, len(d), bytearray(d)) for n, d in found.items()], "name string, size long, d binary").select("name", "size", F.md5("d").alias("digest"))


@query(INDEXED + """ select 1 as version, 0 as profile, cast((select count(*) from p where in_index) as bigint) as n_entries, cast((select begins - 51 from base) as bigint) as index_size, true as intact""")
def archive_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, index and integrity hash of an archive, stored against computed."""
    datasource.register(spark)
    head = spark.read.format("quillon").option("view", "header").load(_indexed(spark, sf_dir))
    return head.select("version", "profile", "n_entries", "index_size", (F.col("stored_hash") == F.col("computed_hash")).alias("intact"))


@query(INDEXED + """ select string_agg(name, ',' order by name) as named from p where in_index""")
def reader_error_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive without a manifest is refused with its priority names, sorted."""
    path = _indexed(spark, sf_dir)
    try:
        reader.read(spark, path)
        said = ""
    except ValueError as e:
        said = str(e)
    named = said[said.index("[") + 1 : said.rindex("]")].replace("'", "").replace(" ", "") if "[" in said else None
    return spark.createDataFrame([(named,)], "named string")


@query("""with n as (select case when item_id % 8 = 1 then 'METADATA/' || item_id || '.parquet' when item_id = 0 then 'COLLECTION.json' else 'B/' || item_id || '.txt' end as name, item_id from benchmark where strlen(text) > 0)
select name, name not like 'B/%' as indexed, cast(row_number() over (order by case when name like 'B/%' then 0 else 1 end, item_id) as bigint) as place from n""")
def levels_archive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchical archive: priority files come last, as one block in the index, padding before them."""
    datasource.register(spark)
    k = F.col("ord")
    name = F.when(k == 0, c.COLLECTION_NAME).when(k % 8 == 1, F.concat(F.lit(c.LEVEL_DIR), k.cast("string"), F.lit(".parquet"))).otherwise(F.col("name"))
    path = writer.write_archive(items(spark, sf_dir).withColumn("name", name), f"{_folder(spark)}/levels.zip", "levels")
    view = lambda v: spark.read.format("quillon").option("view", v).load(path)
    data = view("central_directory").where(~F.col("name").isin(*c.RESERVED_NAMES))
    placed = validate.numbered(data.select("name", "lfh_offset"), "lfh_offset", 4096).withColumn("place", F.col("ord") + 1)
    index = view("index").select(F.col("name").alias("i"))
    return placed.join(index, placed["name"] == index["i"], "left").select("name", F.col("i").isNotNull().alias("indexed"), "place")


def _served(spark: SparkSession, path: str) -> str:
    """The URL of a file that the driver serves by ranges for as long as it runs."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Ranges(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            source = io.Source(path)
            first, _, last = self.headers["Range"].removeprefix("bytes=").partition("-")
            end = min(int(last) + 1, source.size)
            data = source.get(int(first), end - int(first))
            source.close()
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{end - 1}/{source.size}")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_HEAD(self) -> None:
            self.send_response(200)
            self.send_header("Content-Length", str(io.Source(path).size))
            self.end_headers()

        def log_message(self, *of) -> None:
            pass

    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    try:
        server = ThreadingHTTPServer((host, 0), Ranges)
    except OSError:  # a name that this machine does not have
        host = "127.0.0.1"
        server = ThreadingHTTPServer((host, 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://{host}:{server.server_port}/ds.zip"


@query(FILES + 'select name, "offset", size, md5(text) as digest from flat')
def http_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive behind HTTP: index and manifest by range requests, payloads by those of the executors."""
    url = _served(spark, writer.create(f"{_folder(spark)}/ds.zip", files(spark, sf_dir)))
    found = whole(reader.read(spark, url)).where(F.col(f"`{c.VSI_COLUMN}`").endswith("," + x.vsi_base(url)))
    return io.with_payloads(found.select("name", "offset", "size"), url).select("name", "offset", "size", F.md5("payload").alias("digest"))


# Catalogs and datasets ---------------------------------------------------------------------------------------------


@query(ENTRIES + """select name, source || '.zip' as shard, '/vsisubfile/' || (lfh_offset + lfh_size) || '_' || size as range, size from flat""")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of shards written as INDEX.parquet and read by its suffix."""
    path = f"{_folder(spark)}/INDEX.parquet"
    plan = layout.plan_flat(entries(spark, sf_dir, "source"))
    plan.select("name", "offset", "size", F.concat("source", F.lit(".zip")).alias("shard")).write.parquet(path)
    vsi = F.col(f"`{c.VSI_COLUMN}`")
    return reader.read(spark, path).select("name", x.basename(vsi).alias("shard"), F.substring_index(vsi, ",", 1).alias("range"), "size")


@query("""select 'd' || (doc_id % 4) || '.zip' as shard, 'DATA/' || doc_id || '.txt' as name, '/vsisubfile/' || doc_id || '_' || n_chars || ',/sets/d' || (doc_id % 4) || '.zip' as vsi from documents""")
def incremental_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that arrive in two lots; a stream appends each of them to a catalog once."""
    from quillon.streaming.discovery import append_catalog, shard_stream

    folder = _folder(spark)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("DATA/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("doc_id").alias("offset"), F.col("n_chars").alias("size"))
    store, place = resolved(folder)
    store.create_dir(f"{place}/in")
    for lot in ((0, 1), (2, 3), ()):
        for k in lot:
            writer.write_manifest(docs.where(F.col("offset") % 4 == k).withColumns({"ord": F.col("offset"), "offset": F.col("offset").cast("decimal(20,0)"), "size": F.col("size").cast("decimal(20,0)")}), f"{folder}/in/d{k}.parquet")
        schema = spark.read.parquet(f"{folder}/in/d0.parquet").schema
        append_catalog(shard_stream(spark, f"{folder}/in", schema, "/sets/"), f"{folder}/catalog", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/catalog").select("shard", "name", F.col(f"`{c.VSI_COLUMN}`").alias("vsi"))


def _dataset(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Level tables of orders and their lines, written in a folder; returned as entries."""
    samples, lines = levels(spark, sf_dir)
    store, place = resolved(folder)
    store.create_dir(f"{place}/METADATA", recursive=True)
    lines = lines.groupBy("parent_id", F.col("name").alias("id")).agg(F.min("offset").alias("internal:offset"), F.min("size").alias("internal:size"))
    rank = layout.prefix_sum(samples.withColumnRenamed("id", "own"), F.lit(1), "idx", "own")
    tables = {"collection": rank.orderBy("idx").select(F.col("own").alias("id"), "o_orderstatus"), "sample": lines.orderBy("parent_id", "id")}
    out = [(k, f"METADATA/{name}.parquet", writer.write_table(df, f"{folder}/METADATA/{name}.parquet")) for k, (name, df) in enumerate(tables.items())]
    with store.open_output_stream(f"{place}/COLLECTION.json", compression=None) as f:
        f.write(json.dumps({"id": "orders", "levels": list(tables)}).encode())
    out.append((len(out), "COLLECTION.json", f"{folder}/COLLECTION.json"))
    return writer.entries_of(spark.createDataFrame(out, "ord long, name string, path string"))


def _dataset_archive(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark)
    return writer.write_archive(_dataset(spark, sf_dir, f"{folder}/d"), f"{folder}/d.zip", "levels")


LINES = LEVELS + """, v as (select parent_id, name as id, min("offset") as o, min(size) as s from files group by 1, 2)"""


@query(LINES + " select parent_id, id, '/vsisubfile/' || o || '_' || s as range from v where parent_id >= 10 and parent_id < 40")
def dataset_sample_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a level of a hierarchical archive for a half-open range of samples."""
    df = reader.read_dataset(spark, _dataset_archive(spark, sf_dir), "sample", (10, 40))
    return df.select("parent_id", "id", F.substring_index(F.col(f"`{c.VSI_COLUMN}`"), ",", 1).alias("range"))


@query(LINES + """, n as (select *, row_number() over (order by id) - 1 as idx from samples), w as (select parent_id, max(case when id = 'B01.tif' then '/vsisubfile/' || o || '_' || s end) as b01, max(case when id = 'img3.tif' then '/vsisubfile/' || o || '_' || s end) as img3 from v group by 1)
select cast(idx as bigint) as idx, n.id, o_orderstatus, b01, img3 from n left join w on n.id = parent_id where idx >= 5 and idx < 300""")
def dataset_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample with the paths of its leaves as columns."""
    df = reader.read_samples(spark, _dataset_archive(spark, sf_dir), (5, 300), leaves=["B01.tif", "img3.tif"])
    return df.select("idx", "id", "o_orderstatus", *(F.substring_index(F.col(f"`{n}`"), ",", 1).alias(n.split(".")[0].lower()) for n in ("B01.tif", "img3.tif")))


@query(LINES + " select parent_id, id, o as \"offset\", s as size from v")
def dataset_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level of a dataset that lies in a folder as plain files."""
    folder = _folder(spark)
    _dataset(spark, sf_dir, folder)
    df = reader.Dataset(spark, folder).level("sample")
    return df.select("parent_id", "id", F.col("`internal:offset`").alias("offset"), F.col("`internal:size`").alias("size"))


@query("select 'orders' as id, 'collection,sample' as levels union all select 'orders', 'collection,sample'")
def dataset_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COLLECTION.json and the levels of a dataset in an archive and in a folder."""
    folder = _folder(spark)
    path = writer.write_archive(_dataset(spark, sf_dir, f"{folder}/d"), f"{folder}/d.zip", "levels")
    found = [reader.Dataset(spark, p) for p in (path, f"{folder}/d")]
    return spark.createDataFrame([(d.collection["id"], ",".join(d.levels)) for d in found], "id string, levels string")


@query("""select p_partkey, cast(rank() over (order by p_size, p_partkey % 30, p_partkey % 7) as int) as place from part""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic versions in their order, which is not that of their letters."""
    from pyspark.sql import Window as W

    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat_ws(".", F.concat(F.lit("v"), F.col("p_size").cast("string")), (k % 30).cast("string"), (k % 7).cast("string")).alias("version"))
    return rows.select("p_partkey", F.rank().over(W.orderBy(hierarchy.version_key("version"))).alias("place"))


@query(ENTRIES + ", n as (select count(*) as n from flat) select cast(k as bigint) as batch, cast(least(100, n - 100 * k) as bigint) as paths from n, range(0, 100000) t(k) where 100 * k < n")
def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual paths in batches of 100 for a loader."""
    plan = reader.with_vsi(layout.plan_flat(entries(spark, sf_dir)), F.lit("/data/ds.zip"))
    return spark.createDataFrame([(k, len(b)) for k, b in enumerate(tablefunctions.path_batches(plan, 100))], "batch long, paths long")


# Rules -------------------------------------------------------------------------------------------------------------


@query("""select * from (values ('no path', 'the input table lacks required column(s) [''path'']'), ('offset given', 'the input table has reserved column(s) [''offset'']; they are computed'),
  ('embedded path', 'an embedded manifest may not have a column path'), ('embedded without size', 'the manifest lacks required column(s) [''size'']'), ('catalog without shard', 'x lacks required column(s) [''shard'']'),
  ('empty', 'INVALID_NAME'), ('missing file', 'the source of ''B/gone.txt'' does not exist')) t(rule, said)""")
def input_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tables of input, embedded manifests and catalogs are refused for."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("B/"), F.col("item_id").cast("string")).alias("name"), F.lit("/none").alias("path"))
    cases = {
        "no path": lambda: validate.check_input_columns(rows.drop("path")),
        "offset given": lambda: validate.check_input_columns(rows.withColumn("offset", F.lit(1))),
        "embedded path": lambda: validate.check_manifest_columns(["name", "offset", "size", "path"]),
        "embedded without size": lambda: validate.check_manifest_columns(["name", "offset"]),
        "catalog without shard": lambda: reader._required(rows.selectExpr("name", "ord as offset", "1 as size"), reader.CATALOG_COLUMNS, "x"),
        "empty": lambda: validate.raise_first(validate.input_faults(rows.limit(0))),
        "missing file": lambda: writer.with_sizes(rows.limit(1).withColumn("name", F.lit("B/gone.txt"))).collect(),
    }
    out = []
    for rule, test in cases.items():
        try:
            test()
            out.append((rule, "accepted"))
        except ArchiveError as e:
            out.append((rule, e.code))
        except ValueError as e:
            out.append((rule, str(e)))
        except Exception as e:  # of a task
            said = str(e)
            at = said.rfind("the source of")
            out.append((rule, said[at : said.find(":", at)] if at >= 0 else said))
    return spark.createDataFrame(out, "rule string, said string")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    name = F.when(k % 17 == 3, F.concat(F.repeat(F.lit("é"), 40_000), k.cast("string"))).otherwise(F.concat(F.lit("DATA/"), k.cast("string")))
    return docs.select(k.alias("ord"), name.alias("name"), F.when(k % 13 == 0, 0).when(k % 13 == 1, x.byte_length("text") * 100_000_000).otherwise(x.byte_length("text")).alias("size"))


@query("select doc_id as ord, 'zero-byte entry' as detail from documents where doc_id % 13 = 0 or strlen(text) = 0")
def validate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.empty_faults(_sized(spark, sf_dir)).select("ord", "detail")


@query("select doc_id as ord, strlen(repeat('é', 40000) || doc_id) as bytes, 'INVALID_NAME' as code from documents where doc_id % 17 = 3")
def validate_long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.long_name_faults(_sized(spark, sf_dir)).select("ord", x.byte_length("name").alias("bytes"), "code")


@query("select doc_id as ord, cast(strlen(text) * 100000000 as bigint) as size from documents where doc_id % 13 = 1 and strlen(text) * 100000000 >= 4294967295")
def validate_zip32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that need ZIP64."""
    return validate.zip32_faults(_sized(spark, sf_dir)).select("ord", F.col("detail").cast("long").alias("size"))


@query(ENTRIES + """, d as (select ord, lfh_offset + lfh_size - case when ord % 50 = 7 then 100000 else 0 end as o from flat)
select ord from (select ord, o, max(o) over (order by ord rows between unbounded preceding and 1 preceding) as before from d) where o <= before""")
def validate_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = layout.plan_flat(entries(spark, sf_dir))
    return validate.increasing_faults(plan.withColumn("offset", F.col("offset") - F.when(F.col("ord") % 50 == 7, 100_000).otherwise(0))).select("ord")


@query("""select cast(null as bigint) as ord, 'DATA/' || doc_id as name, 'null ord' as detail from documents where doc_id % 19 = 4
  union all select cast(doc_id - 1 as bigint), 'DATA/' || doc_id, 'repeated ord' from documents where doc_id % 19 = 6 and (doc_id - 1) % 19 <> 4""")
def validate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(k % 19 == 4, None).when(k % 19 == 6, k - 1).otherwise(k).alias("ord"), F.concat(F.lit("DATA/"), k.cast("string")).alias("name"), k.alias("own"))
    # Of two rows the one of the later name is told; names here grow with their ids within a pair.
    rows = rows.withColumn("name", F.concat(F.lpad(F.col("own").cast("string"), 12, "0"), F.col("name")))
    return validate.order_faults(rows).select("ord", F.substr("name", F.lit(13)).alias("name"), "detail")


@query("""select ord, name, 'name may not be in an index' as detail from (select doc_id as ord, case doc_id % 23 when 1 then '' when 2 then null when 3 then '@index' else 'd' || doc_id end as name from documents) where name is null or name = '' or name = '@index'
  union all select doc_id, 'd' || (doc_id - 1), 'duplicate name' from documents where doc_id % 23 = 5 union all select doc_id, case doc_id % 23 when 1 then '' else '@index' end, 'duplicate name' from documents where doc_id % 23 in (1, 3) and doc_id >= 23""")
def validate_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 23 == 1, "").when(k % 23 == 2, None).when(k % 23 == 3, c.INDEX_NAME).when(k % 23 == 5, F.concat(F.lit("d"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("d"), k.cast("string")))
    index = table(spark, sf_dir, "documents").select(k.alias("ord"), name.alias("name"), k.alias("offset"), F.lit(5).cast("long").alias("size"))
    return validate.index_faults(index).select("ord", "name", "detail")


@query("""with r as (select doc_id as ord, case when doc_id % 11 = 2 then 'f' || doc_id || '/' when doc_id % 11 = 8 then 'f' || (doc_id - 1) else 'f' || doc_id end as name from documents)
select ord, name from (select *, row_number() over (partition by name order by ord) as n from r) where n > 1""")
def validate_directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a directory has twice."""
    k = F.col("ord") % 11
    twice = F.when(k == 2, F.col("name")).when(k == 8, F.concat(F.lit("f"), (F.col("ord") - 1).cast("string"))).otherwise(F.concat(F.lit("f"), F.col("ord").cast("string")))
    return validate.directory_faults(records(spark, sf_dir).withColumn("name", twice)).where("code = 'DUPLICATE_NAME'").select("ord", "name")


@query("""select doc_id as ord, 'd' || doc_id as name, 'not allowed in a flat index' as detail from documents where doc_id % 100 = 3 union all select null, null, '2 manifests' union all select null, null, '0 manifests'""")
def validate_flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with others beside two manifests, and one with nothing in it."""
    k = F.col("doc_id")
    index = table(spark, sf_dir, "documents").where(k % 100 == 3).select(k.alias("ord"), F.concat(F.lit("d"), k.cast("string")).alias("name"))
    index = index.unionByName(spark.createDataFrame([(-1, c.MANIFEST_NAME), (-2, c.MANIFEST_NAME)], "ord long, name string"))
    found = validate.union(validate.flat_index_faults(index), validate.flat_index_faults(index.limit(0)))
    return found.select("ord", "name", "detail")


@query("""select 'METADATA/' || doc_id || '.parquet' as name from documents where doc_id % 20 = 0 and doc_id % 40 = 0 union all select 'COLLECTION.json'""")
def validate_hierarchy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority files that an index lacks."""
    k = F.col("doc_id")
    name = F.when(k % 20 == 0, F.concat(F.lit(c.LEVEL_DIR), k.cast("string"), F.lit(".parquet"))).otherwise(F.concat(F.lit("DATA/"), k.cast("string")))
    rows = table(spark, sf_dir, "documents").select(k.alias("ord"), name.alias("name"))
    return validate.hierarchy_index_faults(rows.where("ord % 20 = 0 and ord % 40 <> 0"), rows).select("name")


@query("""select doc_id as ord, '@padding' as name, 'second padding entry' as detail from documents where doc_id % 60 = 9 and doc_id > 9 union all select doc_id, '@padding', 'padding in the index' from documents where doc_id % 90 = 9""")
def validate_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("ord"), F.when(k % 60 == 9, c.PADDING_NAME).otherwise(F.concat(F.lit("d"), k.cast("string"))).alias("name"))
    index = table(spark, sf_dir, "documents").select(k.alias("ord"), F.when(k % 90 == 9, c.PADDING_NAME).otherwise(F.concat(F.lit("i"), k.cast("string"))).alias("name"))
    return validate.padding_faults(rows, index).select("ord", "name", "detail")


@query("""with u as (select p_partkey, p_type || '.v1.tif' as name from part), n as (select *, row_number() over (partition by name order by p_partkey) as k from u)
select p_partkey, case when k = 1 then name else regexp_replace(name, '\\.tif$', '-' || (k + 1) || '.tif') end as name from n union all select -1 - row_number() over (order by name), replace(name, '.tif', '-2.tif') from (select distinct name from u)""")
def unique_names_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second name of each kind is taken by an earlier row, so renaming goes on from the third."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(".v1.tif")).alias("name"))
    kinds = rows.select("name").distinct()
    taken = kinds.select((-1 - F.row_number().over(W.orderBy("name"))).cast("long").alias("p_partkey"), F.replace("name", F.lit(".tif"), F.lit("-2.tif")).alias("name"))
    return names.unique_names(rows.unionByName(taken), "name", "p_partkey").select("p_partkey", F.col("unique_name").alias("name"))


# Bytes -------------------------------------------------------------------------------------------------------------

BYTE = "cast('0x' || substr(hex(encode({0})), 2 * i - 1, 2) as int)"


def _crc(text: str) -> str:
    step = "list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)) + z)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({text}) + 1), lambda i: {BYTE.format(text)}::bigint)), lambda h, b: {step}), 4294967295)"


@query(f"""select p_partkey, {_crc('p_name')} as crc, {_crc('(p_name || p_type)')} as combined,
  cast((list_sum(list_transform(range(1, strlen(p_name) + 1), lambda i: (strlen(p_name) - i + 1) * {BYTE.format('p_name')})) + strlen(p_name)) % 65521 * 65536 + (1 + list_sum(list_transform(range(1, strlen(p_name) + 1), lambda i: {BYTE.format('p_name')}))) % 65521 as bigint) as adler from part""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of names, of names and types together from those of each, and Adler-32."""
    data = lambda n: F.encode(n, "utf-8")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.to_binary(F.concat(*(F.lpad(F.hex(v), 8, "0") for v in (F.crc32(data("p_name")), x.byte_length("p_name"), F.crc32(data("p_type")), x.byte_length("p_type"))), F.hex(data("p_name"))), F.lit("hex")).alias("data"))

    def one(d: bytes) -> dict:
        a, n, b, m = (int.from_bytes(d[4 * j : 4 * j + 4], "big") for j in range(4))
        return {"crc": a, "combined": codec.crc_combined([(a, n), (b, m)]), "adler": codec.adler32(d[16:])}

    return decoded(rows, "k long, crc long, combined long, adler long", one).withColumnRenamed("k", "p_partkey")


def _fnv(ranges: str) -> str:
    return f"lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform({ranges}, lambda i: {BYTE.format('text')}::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint), 16, '0'))"


@query(f"select item_id, {_fnv('range(52, strlen(text) + 1)')} as hash from benchmark where strlen(text) > 80")
def integrity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrity hash of texts taken as archives whose index has ten bytes: all of a short one behind its first header."""
    rows = table(spark, sf_dir, "benchmark").where(F.octet_length("text") > 80).select(F.col("item_id").alias("k"), F.encode("text", "utf-8").alias("data"))
    return decoded(rows, "k long, hash string", lambda d: {"hash": f"{io.archive_hash(io.Bytes(d), 10):016x}"}).withColumnRenamed("k", "item_id")


@query("""select o_orderkey, s as usize, p as place, 4 * (case when s >= 4294967295 or p >= 4294967295 then 1 else 0 end) + 16 * (case when s >= 4294967295 then 1 else 0 end) + 8 * (case when p >= 4294967295 then 1 else 0 end) as extra_len
  from (select o_orderkey, o_orderkey * 1000000 + 1 as s, o_orderkey * 700000 as p from orders)""")
def zip64_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory records of large entries, written and read back."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.unhex(F.concat(F.lpad(F.hex(k * 1_000_000 + 1), 16, "0"), F.lpad(F.hex(k * 700_000), 16, "0"))).alias("data"))

    def one(d: bytes) -> dict:
        size, at = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big")
        e = next(codec.parse_directory(codec.directory_record(b"x", size, 7, at), 1))
        return {"usize": e.usize, "place": e.lfh_offset, "extra_len": e.extra_len}

    return decoded(rows, "k long, usize long, place long, extra_len long", one).withColumnRenamed("k", "o_orderkey")


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'INVALID_ZIP_STRUCTURE' when 1 then 'INVALID_ZIP_STRUCTURE' when 2 then case when n >= 65535 or s >= 4294967295 or p >= 4294967295 then 'INVALID_ZIP64' end when 3 then 'INVALID_OFFSET' end as code,
  case when o_orderkey % 6 >= 4 or (o_orderkey % 6 = 2 and n < 65535 and s < 4294967295 and p < 4294967295) then n end as entries, case when o_orderkey % 6 >= 4 or (o_orderkey % 6 = 2 and n < 65535 and s < 4294967295 and p < 4294967295) then p end as place
  from (select o_orderkey, o_orderkey * 11 as n, o_orderkey * 900 as s, o_orderkey * 700000 as p from orders)""")
def end_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End records of directories: whole ones, ones of several segments, cut ones, ones that lack their ZIP64 part or point beyond the archive."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.unhex(F.lpad(F.hex(k), 16, "0")).alias("data"))

    def one(d: bytes) -> dict:
        key = int.from_bytes(d, "big")
        n, size, at = key * 11, key * 900, key * 700_000
        end = codec.end_records(n, size, at)
        kind, whole_ = key % 6, at + size + len(end)
        if kind == 0:
            end = end[:-18] + b"\x01\x00" + end[-16:]  # another segment
        elif kind == 1:
            end = end[-22:][:15]
        elif kind == 2:
            end = end[-22:]
        elif kind == 3:
            whole_ = at + size - 1
        found = codec.parse_end(end, whole_)
        return {"entries": found.entries, "place": found.at}

    return decoded(rows, "k long, code string, entries long, place long", one).withColumnRenamed("k", "o_orderkey")


#: Places of the first header or the index that are damaged, with what is put there and the code that tells it.
DAMAGE = [
    (0, b"X", "INVALID_LFH"), (6, b"\x01", "INVALID_LFH"), (6, b"\x08", "INVALID_LFH"), (6, b"\x40", "INVALID_LFH"), (7, b"\x20", "INVALID_LFH"), (8, b"\x08", "INVALID_LFH"), (18, b"\x00\x00\x00\x00", "INVALID_LFH"), (22, b"\xff\xff\xff\xff", "INVALID_LFH"), (26, b"\x08", "INVALID_LFH"),
    (28, b"\x0d", "INVALID_LFH"), (30, b"-", "INVALID_LFH"), (39, b"\x00", "INVALID_LFH"), (51, b"X", "INVALID_MAGIC"), (55, b"\x02", "UNSUPPORTED_VERSION"), (58, b"\xff\xff", "TRUNCATED_INDEX"), (62, b"\xff", "TRUNCATED_INDEX"),
]


@query("select doc_id, case " + " ".join(f"when doc_id % {len(DAMAGE) + 2} = {k} then '{code}'" for k, (_, _, code) in enumerate(DAMAGE)) + f" when doc_id % {len(DAMAGE) + 2} = {len(DAMAGE)} then 'ARCHIVE_TOO_SMALL' else 'OK' end as code from documents")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First headers and indexes with one damaged field each, told by their codes."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("k"), F.unhex(F.lpad(F.hex(k), 16, "0")).alias("data"))

    def one(d: bytes) -> dict:
        kind = int.from_bytes(d, "big") % (len(DAMAGE) + 2)
        payload = codec.index_payload(1, [(c.MANIFEST_NAME, 100, 5)])
        raw = bytearray(codec.local_header(c.INDEX_NAME.encode(), len(payload), 0, codec.hash_extra()) + payload)
        if kind < len(DAMAGE):
            at, data, _ = DAMAGE[kind]
            raw[at : at + len(data)] = data
        elif kind == len(DAMAGE):
            raw = raw[:40]
        size, _ = codec.parse_index_header(bytes(raw))
        codec.parse_index(bytes(raw[c.INDEX_LFH : c.INDEX_LFH + size]))
        return {"code": "OK"}

    return decoded(rows, "k long, code string", one).withColumnRenamed("k", "doc_id")


@query("""select p_partkey, case p_partkey % 3 when 0 then 'ascii' when 1 then 'utf-8' else 'cp437' end as guess, p_name || case p_partkey % 3 when 0 then '' when 1 then 'é' else 'éÉß' end as name from part""")
def name_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as bytes in ASCII, UTF-8 or the code page of old archives, told apart and read."""
    k = F.col("p_partkey") % 3
    raw = F.unhex(F.concat(F.hex(F.encode("p_name", "utf-8")), F.when(k == 0, "").when(k == 1, "C3A9").otherwise("8290E1")))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", x.encoding_guess("raw").alias("guess"), x.decoded_name("raw").alias("name"))


@query("""select p_partkey, array_to_string(list_transform(range(0, p_size), lambda i: lpad(lower(to_hex((list_reduce(list_prepend(p_partkey & 255, range(0, i + 1)), lambda v, j: (v * 33 + j + p_partkey) & 255))::bigint)), 2, '0')), '') as bytes, repeat('5a', p_size) as padding from part""")
def pattern_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a pattern that tests fill payloads with, and of padding."""
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(x.pattern_bytes("p_partkey", n))).alias("bytes"), F.lower(F.hex(x.padding_bytes(n))).alias("padding"))


@query("""select c_custkey, '''' || replace(c_name || case when c_custkey % 3 = 0 then '''s "x"' else '' end, '''', '''''') || '''' as literal from customer""")
def quoted_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "'s \"x\"").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", x.sql_literal(name).alias("literal"))


@query("select event_id, json_extract_string(props, '$.page') as page, cast(json_extract(props, '$.k') as bigint) as k from events")
def ndjson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of samples as JSON lines, written as text and read with a schema."""
    path = f"{_folder(spark)}/samples.ndjson"
    table(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "sample": '), F.col("props"), F.lit("}")).alias("value")).write.text(path)
    return reader.read_ndjson(spark, path, "event_id long, sample struct<page: string, k: long>").select("event_id", "sample.page", "sample.k")


@query(FILES + ' select item_id, "offset", size from benchmark left join flat on name = \'B/\' || (item_id * 2) || \'.txt\'')
def range_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in the map of names to ranges that an index is."""
    rows = table(spark, sf_dir, "benchmark")
    plan = layout.plan_flat(items(spark, sf_dir).drop("data")).agg(x.range_map("name", "offset", "size").alias("m"))
    asked = F.concat(F.lit("B/"), (F.col("item_id") * 2).cast("string"), F.lit(".txt"))
    found = rows.crossJoin(F.broadcast(plan)).select("item_id", F.try_element_at("m", asked).alias("r"))  # one row: the map
    return found.select("item_id", "r.offset", "r.size")


@query(FILES + ' select cast(row_number() over (order by ord) - 1 as int) as ord, name, "offset", size from flat')
def zipped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of an index (names, offsets, sizes) as rows."""
    plan = layout.plan_flat(items(spark, sf_dir).drop("data"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", "offset", "size")))
    sections = plan.agg(rows.alias("r")).select(F.col("r.name").alias("names"), F.col("r.offset").alias("offsets"), F.col("r.size").alias("sizes"))
    return sections.select(x.zipped("names", "offsets", "sizes"))
