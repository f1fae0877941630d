"""Every query with SQL must equal it on another engine; expressions and validators on cases of their own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import constants as c
from quillon import queries
from quillon.errors import ArchiveError
from quillon.functions import expressions as x
from quillon.operators import hierarchy, ranges, validate
from quillon.plans import layout

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(v[i]) for i in order) for v in values))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("C:\\a\\..\\b", "a/b"), ("//x//y", "x/y"), (" . / .. ", "payload.bin"), (None, "payload.bin"), (c.INDEX_NAME, f"payload/{c.INDEX_NAME}.bin"), ("a\x00b", "ab"), ("CC:/x", "CC:/x"), ("C::/x", "x")],
)
def test_clean_name(spark, raw, clean):
    assert one(spark, x.clean_name(F.lit(raw).cast("string"))) == clean


def test_suffixes(spark):
    for name, want in (("a/b.tif", "a/b-2.tif"), ("a.b/c", "a.b/c-2"), (".x", ".x-2"), ("x.tar.gz", "x.tar-2.gz"), ("", "-2")):
        assert one(spark, x.suffixed(F.lit(name), F.lit(2))) == want


def test_numbers(spark):
    from quillon import codec

    assert one(spark, x.le_value(x.le_bytes(F.lit(258), 4), 0, 4)) == 258
    big = (2**64 - 2).to_bytes(8, "little")
    assert one(spark, x.le_value(F.lit(bytearray(big)), 0, 8)) == 2**64 - 2
    for s in ("", "a", "é" * 50):
        assert one(spark, x.fnv1a64(F.lit(s))) == f"{codec.fnv1a64(s.encode()):016x}"
    assert [one(spark, x.human_bytes(F.lit(n))) for n in (0, 1023, 1024, 10240, 5 << 30)] == ["0 B", "1023 B", "1.00 KiB", "10.0 KiB", "5.00 GiB"]
    assert one(spark, x.status_name(F.lit(101))) == "BUFFER_TOO_SMALL" and one(spark, x.status_name(F.lit(7))) == "UNKNOWN"
    assert one(spark, x.local_header_hex(F.lit("é"), F.lit(5), F.lit(9))) == codec.local_header("é".encode(), 5, 9).hex().upper()
    assert one(spark, x.directory_record_hex(F.lit("é"), F.lit(5), F.lit(77), F.lit(9))) == codec.directory_record("é".encode(), 5, 9, 77).hex().upper()


@pytest.mark.parametrize(("size", "pad"), [(32707, 2), (32708, 1), (32709, 1), (32818, 1), (32819, 0), (100, 32609)])
def test_padding(spark, size, pad):
    assert one(spark, layout.padding_size(F.lit(size))) == pad


def test_prefix_sum_levels(spark):
    df = spark.range(1000).selectExpr("id * 3 as ord", "id % 7 as v").repartition(5)
    want = {r["ord"]: r["v"] for r in df.collect()}
    before, total = {}, 0
    for k in sorted(want):
        before[k] = total
        total += want[k]
    for chunk, levels in ((10, 1), (10, 2), (7, 3), (5000, 2)):
        assert {r["ord"]: r["s"] for r in layout.prefix_sum(df, F.col("v"), "s", "ord", chunk, levels).collect()} == before


def test_zip64_entries_are_planned(spark):
    df = spark.createDataFrame([(0, "a", c.SENTINEL32 - 1), (1, "b", c.SENTINEL32), (2, "c", 1)], "ord long, name string, size long")
    plan = {r["name"]: (r["lfh_offset"], r["lfh_size"]) for r in layout.plan_flat(df).collect()}
    assert plan == {"a": (92, 31), "b": (92 + 31 + c.SENTINEL32 - 1, 51), "c": (92 + 31 + 51 + 2 * c.SENTINEL32 - 1, 31)}


def test_ranges(spark):
    seg = spark.createDataFrame([("a", 0, 10), ("b", 10, 4000), ("c", 4000, 4001)], "label string, start long, end long")
    pts = spark.createDataFrame([(p,) for p in (0, 9, 10, 3999, 4000, 4001)], "at long")
    for f in (ranges.locate, ranges.locate_asof):
        assert {r["at"]: r["label"] for r in f(pts, seg, bin_bytes=64).collect()} == {0: "a", 9: "a", 10: "b", 3999: "b", 4000: "c"}
    r = spark.createDataFrame([("s", 0, 10), ("s", 12, 5), ("s", 100, 1), ("t", 0, 1)], "shard string, offset long, size long")
    got = {(x["shard"], x["offset"]): (x["group_start"], x["group_end"]) for x in ranges.coalesced(r, 2, ["shard"]).collect()}
    assert got == {("s", 0): (0, 17), ("s", 12): (0, 17), ("s", 100): (100, 101), ("t", 0): (0, 1)}


def test_validators(spark):
    cd = spark.createDataFrame([(0, "é", 0, 0, 1, 1), (1, "a", 2048, 8, 1, 1), (2, "a", 0, 0, 1, 2), (3, "d/", 9, 0, 0, 0)], "ord long, name string, flags int, method int, csize long, usize long")
    got = {(r["ord"], r["detail"]) for r in validate.directory_faults(cd).collect()}
    assert got == {(0, "UTF-8 flag missing"), (1, "method is not STORE"), (2, "sizes unequal or zero"), (2, "duplicate name"), (3, "encrypted"), (3, "data descriptor"), (3, "sizes unequal or zero"), (3, "directory entry")}
    index = spark.createDataFrame([(0, c.MANIFEST_NAME, 5, 1), (1, "x", 5, 1)], "ord int, name string, offset long, size long")
    assert [r["name"] for r in validate.flat_index_faults(index).collect()] == ["x"] and validate.flat_index_faults(index.limit(0)).count() == 1
    assert {r["name"] for r in validate.hierarchy_index_faults(index, spark.createDataFrame([("METADATA/a.parquet",), ("DATA/b",)], "name string")).collect()} == {"METADATA/a.parquet", "COLLECTION.json"}
    pads = spark.createDataFrame([(0, c.PADDING_NAME), (1, c.PADDING_NAME)], "ord long, name string")
    assert validate.padding_faults(pads, pads).count() == 3
    assert [r["ord"] for r in validate.increasing_faults(spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "ord long, offset long")).collect()] == [1]
    assert validate.long_name_faults(spark.createDataFrame([("é" * 32768,), ("e" * 65535,)], "name string")).count() == 1
    with pytest.raises(ArchiveError, match="DUPLICATE"):
        validate.raise_first(validate.duplicate_faults(cd))


def test_contract(spark):
    samples = spark.createDataFrame([(0, 1.0, "a"), (1, None, "b"), (2, 2.0, "c")], "id long, cloud double, name2 string")
    files = spark.createDataFrame([(0, "B02.tif")] + [(0, f"img{k}.tif") for k in range(4)] + [(1, "B02.tif"), (1, "B02.tif")], "parent_id long, name string")
    got = {(r["sample"], r["rule"], r["found"]) for r in hierarchy.contract_faults(samples, files, ["B02.tif", "img*[4,16].tif"], {"cloud": "double", "x": "int"}).collect()}
    assert got == {(1, "B02.tif", "2"), (1, "img*[4,16].tif", "0"), (1, "cloud: double", "null"), (2, "B02.tif", "0"), (2, "img*[4,16].tif", "0"), *((k, "x: int", "missing") for k in range(3))}
    assert one(spark, hierarchy.version_key(F.lit("v1.12.3-rc1"))) == [1, 12, 3]


def test_paths(spark):
    assert x.vsi_base("https://h/a.zip") == "/vsicurl/https://h/a.zip" and x.vsi_base_dir("https://h/d/INDEX.parquet") == "/vsicurl/https://h/d/"
    assert x.vsi_base_dir("/d/INDEX.parquet") == "/d/" and x.vsi_base_dir("/INDEX.parquet") == "/"
    got = [one(spark, x.vsi_store(F.lit(u))) for u in ("s3://b/k", "http://h/k", "/local", "gs://b/k")]
    assert got == ["/vsis3/b/k", "/vsicurl/http://h/k", "/local", "/vsigs/b/k"]


def test_unique_names(spark):
    import random

    from quillon.operators import names

    def slow(rows):
        seen, out = set(), []
        for n in rows:
            k, cand = 2, n
            while cand in seen:
                cand, k = names.add_suffix(n, k), k + 1
            seen.add(cand)
            out.append(cand)
        return out

    r = random.Random(3)
    pool = ["a.txt", "a-2.txt", "a-2-2.txt", "d/a.txt", "d/a-3.txt", "x", "x-2", ".h", "b.tar.gz", "q-1/b.txt"]
    rows = [r.choice(pool) for _ in range(200)] + ["plain.bin"] * 5
    df = spark.createDataFrame(list(enumerate(rows)), "ord long, name string").repartition(4)
    got = {x["ord"]: x["unique_name"] for x in names.unique_names(df).collect()}
    assert [got[k] for k in range(len(rows))] == slow(rows)


def test_encoding_guess(spark):
    got = [one(spark, x.encoding_guess(F.lit(bytearray(b)))) for b in (b"abc", "é".encode(), b"\x82\xff", b"")]
    assert got == ["ascii", "utf-8", "cp437", "ascii"]


@pytest.mark.parametrize("ids", [(0, 1, 2, 3), (5, 7, 9)])
def test_mismatches_equal_sql_for_any_last_item(spark, tmp_path, ids):
    """The last item may be a changed one too; its ids may have gaps, and empty texts are no entries."""
    rows = [(k, "é" * (k + 1)) for k in ids] + [(ids[-1] + 1, ""), (ids[-1] + 2, None)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    df = queries.queries()["stage_mismatches"](spark, str(tmp_path))
    assert rows_of(df) == sorted(con.execute(queries.oracle_sql()["stage_mismatches"]).fetchall())


def rows_of(df):
    return sorted(map(tuple, df.collect()))
