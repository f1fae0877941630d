"""Operators that go by chunks and ranges, against brute force, and how much they ask for."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.functions import expressions as x
from quillon.operators import names, ranges, validate
from quillon.plans import layout
from quillon.sources import datasource, reader, store, tablefunctions, writer
from quillon.sources import io as qio


def brute_groups(rows, gap, most):
    """(offset, size) in order -> (group, start, end) of each."""
    groups, reach, last = [], None, None
    for o, s in sorted(rows):
        if reach is None or o > reach + gap or (most and o // most > last // most):
            groups.append([])
        groups[-1].append((o, s))
        reach, last = max(reach or 0, o + s), o
    return sorted((k, o, s, min(a for a, _ in g), max(a + b for a, b in g)) for k, g in enumerate(groups) for o, s in g)


@pytest.mark.parametrize(("gap", "most", "bin_bytes"), [(0, None, 1000), (50, None, 333), (50, 700, 333), (5, 700, 1 << 20)])
def test_coalescing_equals_brute_force(spark, gap, most, bin_bytes):
    r = random.Random(gap + bin_bytes)
    rows = {k: [(r.randrange(9000), r.randrange(1, 90)) for _ in range(120)] for k in ("a", "b", None)}
    rows["b"] += [(10, 4000), (10, 5), (10, 5)]
    df = spark.createDataFrame([(k, o, s) for k, v in rows.items() for o, s in v], "source string, offset long, size long").repartition(5)
    found = ranges.coalesced(df, gap, ["source"], most, bin_bytes).collect()
    for k, v in rows.items():
        got = sorted((g["range_group"], g["offset"], g["size"], g["group_start"], g["group_end"]) for g in found if g["source"] == k)
        assert got == brute_groups(v, gap, most)
    one = ranges.coalesced(df.where("source = 'b'").drop("source"), gap, None, most, bin_bytes)
    assert sorted((g["range_group"], g["offset"], g["size"], g["group_start"], g["group_end"]) for g in one.collect()) == brute_groups(rows["b"], gap, most)


def test_rows_without_a_place_stay(spark):
    df = spark.createDataFrame([(0, "a", 10), (None, "n", 7), (5, "b", 20), (5, "c", 30), (9000, "d", 1)], "ord long, name string, size long")
    rows = {r["name"]: r["lfh_offset"] for r in layout.plan_flat(df, chunk=4).collect()}
    assert rows == {"a": 92, "n": None, "b": 92 + 31 + 10, "c": 92 + 2 * 31 + 30, "d": 92 + 3 * 31 + 60}
    assert sorted((r["ord"] is None, r["name"], r["detail"]) for r in validate.order_faults(df).collect()) == [(False, "c", "repeated ord"), (True, "n", "null ord")]
    with pytest.raises(ArchiveError, match="ord"):
        writer.write_archive(df.withColumn("data", F.lit("x" * 5).cast("binary")), "/tmp/quillon-never.zip")


def test_increasing_equals_brute_force(spark):
    r = random.Random(4)
    offsets = [10 * k - r.randrange(60) * (r.random() < 0.1) for k in range(20_000)]
    df = spark.createDataFrame(list(enumerate(offsets)), "ord long, offset long")
    want, most = [], None
    for k, o in enumerate(offsets):
        if most is not None and o <= most:
            want.append(k)
        most = o if most is None else max(most, o)
    found = validate.increasing_faults(df)
    assert sorted(f["ord"] for f in found.collect()) == want


def test_directories_are_read_by_ranges(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as ord", "concat('DATA/', id) as name", "cast(repeat('x', 1 + id % 500) as binary) as data", "1L + id % 500 as size")
    path = writer.write_archive(df, str(tmp_path / "many.zip"), partitions=4)
    source = qio.Source(path)
    parts = qio.directory_parts(source, 450)
    assert len(parts) == 7 and source.requests <= 3 and parts[-1][1] == 3001
    entries = qio.directory(source)[1]
    source.requests = 0
    found = dict((e.name, o) for e, o in qio.payload_offsets(source, entries))
    assert source.requests <= 2 and found["DATA/7"] == qio.payload_offset(source, next(e.lfh_offset for e in entries if e.name == "DATA/7"))
    datasource.register(spark)
    rows = spark.read.format("quillon").option("view", "central_directory").load(path)
    with zipfile.ZipFile(path) as z:
        assert {(i.filename, i.header_offset, i.CRC) for i in z.infolist()} == {(r["name"], r["lfh_offset"], r["crc"]) for r in rows.collect()}
    assert sorted(r["ord"] for r in rows.select("ord").collect()) == list(range(3001))


def test_archives_by_uri(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"f{k}", bytes([k]) * 5000) for k in range(20)], "ord long, name string, data binary")
    entries = writer.entries_of(rows, "data")
    manifest = writer.manifest_bytes(layout.plan_flat(entries.drop("data")).select("ord", "name", *(F.col(n).cast("decimal(20,0)").alias(n) for n in ("offset", "size"))))
    uri = writer.write_archive(entries, f"file://{tmp_path}/u.zip", "flat", manifest)
    assert uri == f"file://{tmp_path}/u.zip" and [p.name for p in tmp_path.iterdir()] == ["u.zip"]
    found = reader.read(spark, uri)
    assert found.where("name = 'f3'").first()[c.VSI_COLUMN].endswith(f",{tmp_path}/u.zip")
    payloads = {r["name"]: bytes(r["payload"]) for r in qio.with_payloads(reader.read(spark, uri, gdal_vsi=False), uri).collect()}
    assert payloads == {f"f{k}": bytes([k]) * 5000 for k in range(20)}


def test_manifests_have_row_groups_in_order(spark, tmp_path):
    rows = spark.range(2500).selectExpr("2499 - id as ord", "concat('n', 2499 - id) as name", "cast(2499 - id as decimal(20,0)) as offset", "cast(7 as decimal(20,0)) as size", "'é' as extra").repartition(7)
    path = writer.write_manifest(rows, str(tmp_path / "m.parquet"), {"k": "v"}, row_group=1000)
    import pyarrow.parquet as pq

    file = pq.ParquetFile(path)
    assert file.num_row_groups == 3 and file.schema_arrow.metadata[b"k"] == b"v"
    assert file.read().column("offset").to_pylist() == list(range(2500))


def test_the_manifest_view_has_a_task_for_each_row_group(spark, tmp_path):
    entries = writer.entries_of(spark.createDataFrame([(k, f"f{k}", b"x" * 2000) for k in range(60)], "ord long, name string, data binary"), "data")
    plan = layout.plan_flat(entries.drop("data")).select("ord", "name", *(F.col(n).cast("decimal(20,0)").alias(n) for n in ("offset", "size")))
    path = writer.write_archive(entries, str(tmp_path / "g.zip"), "flat", writer.manifest_bytes(plan, row_group=20))
    datasource.register(spark)
    df = spark.read.format("quillon").option("view", "manifest").option("gdal_vsi", "false").load(path)
    assert df.rdd.getNumPartitions() == 3 and df.columns == ["name", "offset", "size"] and df.count() == 60
    assert tablefunctions.embedded(path).num_row_groups == 3


def test_vsi_of_stores():
    assert x.vsi_base("s3://b/k.zip") == "/vsis3/b/k.zip" and x.vsi_base("file:///d/k.zip") == "/d/k.zip"
    assert x.vsi_base_dir("gs://b/d/INDEX.parquet") == "/vsigs/b/d/" and x.vsi_base_dir("https://h/d/INDEX.parquet") == "/vsicurl/https://h/d/"


def test_scratch_needs_a_shared_folder(spark):
    assert store.scratch(spark).startswith("file://")


def test_unique_names_equal_the_sequential_rule(spark):
    r = random.Random(8)
    given = [r.choice(["a.txt", "a-2.txt", "a-2-2.txt", "d/b", "d/b-2", "c.tar.gz", "a-3.txt"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(given)), "ord long, name string").repartition(4)
    got = [n["unique_name"] for n in sorted(names.unique_names(df).collect(), key=lambda n: n["ord"])]
    assert len(set(got)) == len(got) and got == names.renamed(given)


def test_levels_of_datasets_pass_the_driver_in_batches(spark, monkeypatch):
    from quillon import queries

    def whole(*_):
        raise AssertionError("a level's table is in the driver's memory")

    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(spark.range(0)), name, whole)
    assert sorted(map(tuple, queries.queries()["dataset_collection"](spark, "/root/testdata/sf0.001").collect())) == [("orders", "collection,sample")] * 2


def test_tables_of_many_pieces_are_one_file_in_order(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(3000).repartition(7).selectExpr("id div 3 as k", "concat('n', id % 3) as `a:b`", "if(id % 5 = 0, null, id) as v").orderBy("k", "a:b")
    file = pq.ParquetFile(writer.write_table(rows, str(tmp_path / "t.parquet"), row_group=1000))
    assert file.num_row_groups == 3 and [tuple(r.values()) for r in file.read().to_pylist()] == [(i // 3, f"n{i % 3}", None if i % 5 == 0 else i) for i in range(3000)]


def test_checksums_are_combined_in_microseconds():
    import time
    import zlib

    from quillon import codec

    parts = [(bytes([k % 251]) * (k % 60), bytes([k % 7]) * (k % 31)) for k in range(20_000)]
    began = time.process_time()
    found = [codec.crc_combined([(zlib.crc32(a), len(a)), (zlib.crc32(b), len(b))]) for a, b in parts]
    assert time.process_time() - began < 5  # was 20 and more
    assert found == [zlib.crc32(a + b) for a, b in parts]
    zeros = bytes(70_000)  # lengths of many bits
    assert codec.crc_combined([(zlib.crc32(b"x"), 1), (zlib.crc32(zeros), len(zeros)), (0, 0)]) == zlib.crc32(b"x" + zeros)
    assert codec.crc_combined([(1, 5), (0, 1 << 40), (0, 1 << 40)]) == codec.crc_combined([(1, 5), (0, 1 << 41)])
