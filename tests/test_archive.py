"""Archives as bytes: written by us, read by zipfile and by independent code here."""

import io
import json
import os
import struct
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon import codec
from quillon import constants as c
from quillon.errors import ArchiveError
from quillon.sources import datasource, reader, writer
from quillon.sources import io as qio


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "small.txt").write_bytes(b"hello there\n" * 8)
    (tmp_path / "medium.bin").write_bytes(bytes(range(256)) * 160)
    return tmp_path


@pytest.fixture()
def table(spark, files):
    rows = [(0, "a.txt", str(files / "small.txt"), "text"), (1, "b.bin", str(files / "medium.bin"), "binary")]
    return spark.createDataFrame(rows, "ord long, name string, path string, category string")


@pytest.fixture()
def archive(table, files):
    return writer.create(str(files / "ds.zip"), table, {"geo": '{"version": "1.0.0"}'})


def entries(spark, n, size=100, profile_names=None):
    rows = [(i, (profile_names or (lambda i: f"DATA/é{i}.bin"))(i), bytes([i % 256]) * (size + i)) for i in range(n)]
    return writer.entries_of(spark.createDataFrame(rows, "ord long, name string, data binary"), "data")


def check_archive(path):
    raw = open(path, "rb").read()
    assert raw[:4] == b"PK\x03\x04" and raw[30:39] == c.INDEX_NAME.encode() and raw[-22:-18] == b"PK\x05\x06" and raw[-2:] == b"\x00\x00"
    assert len(raw) >= 32819
    size = struct.unpack_from("<I", raw, 18)[0]
    stored = struct.unpack_from("<Q", raw, 43)[0]
    start = max(51 + size, len(raw) - 32768)
    assert stored == fnv(raw[51 : 51 + size] + raw[start:])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert all(i.compress_type == 0 and i.file_size == i.compress_size > 0 and not i.flag_bits & 9 for i in z.infolist())
        assert len(set(z.namelist())) == len(z.namelist())
    return raw


def test_flat_archive(spark, archive, files):
    raw = check_archive(archive)
    index = codec.parse_index(raw[51 : 51 + struct.unpack_from("<I", raw, 18)[0]], len(raw))
    assert index.profile == 1 and [n for n, _, _ in index.entries] == [c.MANIFEST_NAME]
    o, s = index.find(c.MANIFEST_NAME)
    manifest = pq.read_table(io.BytesIO(raw[o : o + s]))
    assert manifest.schema.names == ["name", "offset", "size", "category"]
    assert manifest.schema.field("offset").type == pa.uint64() and manifest.schema.metadata[b"geo"]
    assert manifest.column("offset").to_pylist() == [127, 258] and manifest.column("size").to_pylist() == [96, 40960]
    for name, offset, size in zip(*(manifest.column(x).to_pylist() for x in ("name", "offset", "size"))):
        source = {"a.txt": "small.txt", "b.bin": "medium.bin"}[name]
        assert raw[offset : offset + size] == (files / source).read_bytes()


def test_read_back(spark, archive):
    df = reader.read(spark, archive)
    rows = {r["name"]: r for r in df.collect()}
    assert rows["a.txt"][c.VSI_COLUMN] == f"/vsisubfile/127_96,{archive}"
    assert c.VSI_COLUMN not in reader.read(spark, archive, gdal_vsi=False).columns
    plan = df.where("size > 1000").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(size), GreaterThan(size" in plan
    reader.create_view(spark, "m", archive)
    assert spark.sql("select name from m where name like '%.bin' order by size desc limit 5").collect()[0][0] == "b.bin"


def test_small_archives_are_padded_and_readable(spark, files):
    df = spark.createDataFrame([(0, "a.txt", str(files / "small.txt"))], "ord long, name string, path string")
    path = writer.create(str(files / "small.zip"), df)
    raw = check_archive(path)
    assert len(raw) < 65536 and c.PADDING_NAME in zipfile.ZipFile(path).namelist()
    assert reader.read(spark, path).count() == 1


def test_catalog(spark, archive, files):
    pq.write_table(pa.table({"name": ["a"], "offset": pa.array([1], pa.uint64()), "size": pa.array([2], pa.uint64()), "shard": ["x.zip"]}), files / "INDEX.parquet")
    row = reader.read(spark, str(files / "INDEX.parquet")).first()
    assert row[c.VSI_COLUMN] == f"/vsisubfile/1_2,{files}/x.zip"
    with pytest.raises(ValueError):
        reader.read(spark, str(files / "small.txt"))


def test_none_and_hierarchical_profiles(spark, files):
    e = entries(spark, 20, 3000).selectExpr("*", "ord % 2 = 0 as in_index")
    path = writer.write_archive(e, str(files / "none.zip"), partitions=3)
    check_archive(path)
    got = reader.priority_files(path)
    assert got == {f"DATA/é{i}.bin": bytes([i]) * (3000 + i) for i in range(0, 20, 2)}
    names = lambda i: "COLLECTION.json" if i == 1 else f"METADATA/l{i}.parquet" if i < 4 else f"DATA/{i}"
    path = writer.write_archive(entries(spark, 9, 10, names), str(files / "levels.zip"), "levels")
    raw = check_archive(path)
    order = [n for n, _ in sorted(((i.filename, i.header_offset) for i in zipfile.ZipFile(path).infolist()), key=lambda t: t[1])]
    assert order[-5:] == [c.PADDING_NAME, "METADATA/l0.parquet", "COLLECTION.json", "METADATA/l2.parquet", "METADATA/l3.parquet"]
    assert codec.parse_index(raw[51 : 51 + struct.unpack_from("<I", raw, 18)[0]]).profile == 2


def test_data_source_views(spark, archive):
    datasource.register(spark)
    view = lambda v: spark.read.format("quillon").option("view", v).load(archive)
    cd = {r["name"]: r for r in view("central_directory").collect()}
    with zipfile.ZipFile(archive) as z:
        assert {i.filename: (i.header_offset, i.CRC, i.file_size) for i in z.infolist()} == {n: (r["lfh_offset"], r["crc"], r["usize"]) for n, r in cd.items()}
    assert cd["a.txt"]["offset"] == 127
    head = view("header").first()
    assert head["stored_hash"] == head["computed_hash"] and head["profile"] == 1
    seg = sorted((r["start"], r["end"]) for r in view("segments").collect())
    assert seg[0][0] == 0 and seg[-1][1] == os.path.getsize(archive) and all(a[1] == b[0] for a, b in zip(seg, seg[1:]))
    spark.sql(f"create or replace temporary view i using quillon options (path '{archive}', view 'index')")
    assert spark.sql("select name from i").first()[0] == c.MANIFEST_NAME


@pytest.mark.parametrize(
    ("at", "data", "code"),
    [(0, b"X", "INVALID_LFH"), (6, b"\x01", "INVALID_LFH"), (8, b"\x08", "INVALID_LFH"), (39, b"\x00", "INVALID_LFH"), (51, b"X", "INVALID_MAGIC"), (55, b"\x02", "UNSUPPORTED_VERSION"), (58, b"\xff", "TRUNCATED_INDEX"), (-30, b"\xff", "HASH_MISMATCH")],
)
def test_damage_is_named(spark, archive, at, data, code):
    raw = bytearray(open(archive, "rb").read())
    at %= len(raw)
    raw[at : at + len(data)] = data
    open(archive, "wb").write(raw)
    with pytest.raises(ArchiveError) as e:
        reader.read(spark, archive)
    assert e.value.code == code


def test_index_damage():
    good = codec.index_payload(0, [("a", 100, 5), ("b", 200, 6)])
    assert codec.parse_index(good, 206).entries == [("a", 100, 5), ("b", 200, 6)]
    cases = {
        "TRUNCATED_INDEX": good[:-1],
        "DUPLICATE_NAME": codec.index_payload(0, [("a", 100, 5), ("a", 200, 6)]),
        "INVALID_OFFSET": codec.index_payload(0, [("a", 100, 5), ("b", 200, 7)]),
        "INVALID_NAME": codec.index_payload(0, [("a", 100, 5), (c.INDEX_NAME, 200, 6)]),
    }
    for code, data in cases.items():
        with pytest.raises(ArchiveError) as e:
            codec.parse_index(data, 206)
        assert e.value.code == code
    with pytest.raises(ArchiveError):
        codec.parse_index(codec.index_payload(0, [("a", 2**64 - 1, 5)]))


def test_zip64_records():
    head = codec.local_header(b"x", 2**32, 7)
    assert len(head) == 30 + 1 + 20
    rec = codec.directory_record(b"x", 2**32, 7, 2**33)
    e = next(codec.parse_directory(rec, 1))
    assert (e.usize, e.csize, e.lfh_offset) == (2**32, 2**32, 2**33)
    end = codec.parse_end(codec.end_records(70_000, 10, 2**33), 2**34)
    assert (end.entries, end.size, end.at) == (70_000, 10, 2**33)
    with pytest.raises(ArchiveError) as err:
        codec.parse_end(codec.end_records(70_000, 10, 5)[-22:], 2**34)
    assert err.value.code == "INVALID_ZIP64"


def test_many_entries(spark, files):
    df = spark.range(66_000).selectExpr("id as ord", "concat('f', id) as name", "cast('x' as binary) as data", "1L as size")
    path = writer.write_archive(df, str(files / "many.zip"), partitions=4)
    with zipfile.ZipFile(path) as z:
        assert len(z.namelist()) == 66_001 and z.read("f65999") == b"x"
    assert len(qio.directory(qio.Source(path))[1]) == 66_001


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abcé/", min_size=1, max_size=8).filter(lambda s: s[0] != "/" and "//" not in s and s[-1] != "/"), st.integers(1, 5000)), min_size=1, max_size=12, unique_by=lambda t: t[0]))
def test_plan_write_scan_agree(spark, tmp_path_factory, items):
    df = spark.createDataFrame([(i, n, b"z" * s) for i, (n, s) in enumerate(items)], "ord long, name string, data binary")
    path = writer.write_archive(writer.entries_of(df, "data"), str(tmp_path_factory.mktemp("p") / "x.zip"))
    check_archive(path)
    assert {i.filename: i.file_size for i in zipfile.ZipFile(path).infolist() if not i.filename.startswith("__")} == dict(items)


def test_bad_inputs(spark, table, files, archive):
    make = lambda rows, schema="ord long, name string, path string": writer.create(str(files / "bad.zip"), spark.createDataFrame(rows, schema))
    p = str(files / "small.txt")
    for rows, said in (([(0, "x", p), (1, "x", p)], "duplicate"), ([(0, c.MANIFEST_NAME, p)], "reserved"), ([(0, "../x", p)], "dot"), ([(0, None, p)], "null"), ([], "empty")):
        with pytest.raises(ArchiveError, match=said):
            make(rows)
    with pytest.raises(ValueError, match="reserved"):
        writer.create(str(files / "bad.zip"), table.selectExpr("*", "1 as offset"))
    with pytest.raises(ValueError, match="required column"):
        writer.create(str(files / "bad.zip"), table.drop("path"))
    with pytest.raises(Exception, match="does not exist"):
        make([(0, "x", str(files / "none"))])
    assert not [f for f in os.listdir(files) if "parts" in f]


def test_stage_create_validates(spark, table, files):
    manifest, paths = writer.stage_metadata(table)
    good = files / "m.parquet"
    good.write_bytes(writer.manifest_bytes(manifest))
    check_archive(writer.stage_create(str(files / "s.zip"), paths, str(good)))
    t = pq.read_table(good)
    for change, said in ((t.set_column(1, "offset", pa.array([0, 0], pa.uint64())), "offset mismatch"), (t.slice(0, 1), "rows"), (t.append_column("path", pa.array(["", ""])), "path"), (t.select(["name"]), "required column"), (t.set_column(0, "name", pa.array(["a.txt", None])), "name mismatch")):
        pq.write_table(change, files / "bad.parquet")
        with pytest.raises(ValueError, match=said):
            writer.stage_create(str(files / "s2.zip"), paths, str(files / "bad.parquet"))


def test_http_ranges(spark, archive, files):
    import functools
    import threading
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    class Ranged(SimpleHTTPRequestHandler):
        def do_GET(self):
            data = open(self.translate_path(self.path), "rb").read()
            a, b = self.headers["Range"].removeprefix("bytes=").split("-")
            part = data[int(a) : int(b) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{b}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    class Whole(SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

    for kind in (Ranged, Whole):
        server = ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(kind, directory=str(files)))
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/ds.zip"
        source = qio.Source(url)
        qio.bootstrap(source)
        assert source.requests == 1
        assert reader.read(spark, url).where("name = 'a.txt'").first()[c.VSI_COLUMN] == f"/vsisubfile/127_96,/vsicurl/{url}"
        server.shutdown()


def test_dataset(spark, files):
    sample = pa.table({"parent_id": [0, 0, 1], "id": ["B1.tif", "B2.tif", "B1.tif"], "internal:offset": [1, 2, 3], "internal:size": [4, 5, 6]})
    out = io.BytesIO()
    pq.write_table(sample, out)
    rows = [(0, "DATA/0/x", b"x" * 9), (1, "METADATA/sample.parquet", out.getvalue()), (2, "COLLECTION.json", json.dumps({"id": "d"}).encode())]
    path = writer.write_archive(writer.entries_of(spark.createDataFrame(rows, "ord long, name string, data binary"), "data"), str(files / "h.zip"), "levels")
    assert reader.Dataset(spark, path).collection == {"id": "d"}
    assert reader.read_dataset(spark, path, idx=0).count() == 2 and reader.read_dataset(spark, path, idx=(0, 2)).count() == 3
    wide = {r["parent_id"]: r for r in reader.read_dataset(spark, path, pivot=True).collect()}
    assert wide[0]["B2.tif"] == f"/vsisubfile/2_5,{path}" and wide[1]["B2.tif"] is None
    os.makedirs(files / "folder/METADATA")
    pq.write_table(sample, files / "folder/METADATA/sample.parquet")
    assert reader.Dataset(spark, str(files / "folder")).level("sample").count() == 3
    with pytest.raises(ArchiveError):
        reader.Dataset(spark, writer.write_archive(entries(spark, 3), str(files / "n.zip")))


def test_catalog_stream(spark, files):
    from quillon.streaming.discovery import append_catalog, shard_stream

    (files / "in").mkdir()
    schema = spark.createDataFrame([], "name string, offset long, size long").schema
    for k in (1, 2):
        spark.createDataFrame([(f"n{k}", k, k)], schema).toPandas().to_parquet(files / f"in/s{k}.parquet")
        append_catalog(shard_stream(spark, str(files / "in"), schema, "/d/"), str(files / "cat"), str(files / "ck")).awaitTermination()
        got = spark.read.parquet(str(files / "cat"))
        assert got.count() == k
    assert {r[c.VSI_COLUMN] for r in got.collect()} == {"/vsisubfile/1_1,/d/s1.zip", "/vsisubfile/2_2,/d/s2.zip"}


def test_crc_and_hash():
    import random
    import zlib

    r = random.Random(1)
    for _ in range(20):
        a, b = r.randbytes(r.randrange(300)), r.randbytes(r.randrange(300))
        assert codec.crc_combined([(zlib.crc32(a), len(a)), (zlib.crc32(b), len(b))]) == zlib.crc32(a + b)
    assert codec.fnv1a64(b"") == c.FNV_BASIS and codec.fnv1a64(b"ab") == codec.fnv1a64(b"b", codec.fnv1a64(b"a")) == fnv(b"ab")
    assert codec.hash_ranges(100, 40000) == [(51, 151), (7232, 40000)] and codec.hash_ranges(8000, 40000) == [(51, 40000)]


def test_table_function(spark, archive):
    from quillon.sources import tablefunctions

    tablefunctions.register(spark)
    rows = spark.sql(f"select * from read_archive('{archive}') where name like '%.bin' order by size desc limit 5").collect()
    assert rows[0]["category"] == "binary" and rows[0][c.VSI_COLUMN].startswith("/vsisubfile/258_40960,")
    assert spark.sql(f"select * from read_archive('{archive}', false)").columns == ["name", "offset", "size", "category"]
    assert list(tablefunctions.path_batches(reader.read(spark, archive), 1)) == [[f"/vsisubfile/127_96,{archive}"], [f"/vsisubfile/258_40960,{archive}"]]
