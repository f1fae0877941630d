"""Long rows and many blocks: work grows no faster than the input, and results stay whole."""

import hashlib
import io
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, frames, neardup, warc
from tests.llm.test_kernels import lower, random_texts
from tests.llm.test_operators import documents


def conversation(spark, n):
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    return spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é <x> "), F.col("id").cast("string"), F.repeat(F.lit("y"), 60)).alias("text"))


def test_chats_of_many_turns(spark):
    def seconds(n):
        began = time.time()
        r = chat.digests(chat.read_chats(chat.format_chats(conversation(spark, n)))).collect()[0]
        assert r["n_turns"] == n and r["loss_chars"] == sum(66 + len(str(k)) for k in range(1, n, 2))
        return time.time() - began

    seconds(2000)
    assert seconds(64_000) < 4 * seconds(16_000) + 4


def test_chat_spans_in_code_points_and_bytes(spark):
    for r in chat.format_chats(conversation(spark, 21)).collect():
        data = r["formatted"].encode()
        for s in r["loss_spans"]:
            assert r["formatted"][s["start"] : s["start"] + s["length"]].encode() == data[s["byte_start"] : s["byte_start"] + s["byte_length"]]


def test_warc_records_of_many_bytes():
    def seconds(n):
        payload = hashlib.sha256(b"x").digest() * (n // 32)
        data = warc.member(warc.record(1, "u", payload, "D", None)) + warc.member(warc.record(2, "u", b"small", "D", None))
        began = time.time()
        got = list(warc.Members(io.BytesIO(data), len(data), 0, len(data)))
        took = time.time() - began
        _, payload_back = warc.http_parts(warc.parsed(got[0][1])[1])
        assert len(got) == 2 and bytes(payload_back) == payload
        return took

    seconds(1 << 20)
    assert seconds(200 << 20) < 8 * seconds(50 << 20) + 1


def test_warc_incompressible_records_in_all_ranges():
    import random

    r = random.Random(3)
    members = [warc.member(warc.record(k, "u", r.randbytes(3 << 20 if k == 2 else 70_000), "D", None)) for k in range(5)]
    data = b"".join(members)
    starts = [sum(map(len, members[:k])) for k in range(5)]
    for cut in (len(data), 1 << 20, 300_000, 99_991):
        got = [p for a in range(0, len(data), cut) for p, _ in warc.Members(io.BytesIO(data), len(data), a, min(len(data), a + cut))]
        assert got == starts


def test_decontamination_in_fifty_blocks(spark):
    items = [" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[: 2 + j % 7] for j in range(40)) for k in range(30)]
    benchmark = spark.createDataFrame([*enumerate(items), (100, items[3].upper()), (101, "What is 2+2? Four"), (102, "Be brief!"), (103, "?!"), (104, None), (105, "")], "item_id long, text string")
    texts = random_texts(30, 41, 40)
    texts += [texts[0] + " " + items[3] + " " + texts[1], texts[2] + " what is 2 + 2 four. " + texts[3], "What is 2+2? Four", "What is 2+2? Fourteen", "be brief", "maybe brief", None, "", items[7] + " " + items[8], items[3]]
    docs = documents(spark, texts)
    want = {30: [3, 100], 31: [101], 32: [101], 34: [102], 38: [7, 8], 39: [3, 100]}
    size = sum(len(w) for t in {i.upper() for i in items} for w in decontaminate.windows_of(t.encode()) + decontaminate.windows_of(t.encode(), decontaminate.PASSAGE, decontaminate.PASSAGE_STRIDE))
    for block in (decontaminate.BLOCK_BYTES, size // 50):
        found = decontaminate.marked(docs, benchmark, block)
        assert {r["doc_id"]: r["benchmark_items"] for r in found.collect() if r["benchmark_items"]} == want
        assert found.count() == len(texts)


def test_short_items_against_brute_force(spark):
    texts = random_texts(80, 42, 30)
    plain = [" ".join("".join(c if c.isalnum() else " " for c in lower(t)).split()) for t in texts]
    items = sorted({" ".join(p.split()[a : a + n]) for p in plain[:40:4] for a in (0, 3) for n in (1, 2, 3) if p.split()[a : a + n]})
    items = [i for i in items if len(i.encode()) < decontaminate.LEAST]
    got = decontaminate.marked(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    for r in got:
        assert r["benchmark_items"] == [k for k, i in enumerate(items) if f" {i} " in f" {plain[r['doc_id']]} "]


def test_one_pass_of_python_for_each_block(spark):
    docs = documents(spark, random_texts(5, 43, 20))
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(random_texts(30, 44, 60))], "item_id long, text string")
    plan = decontaminate.marked(docs, benchmark, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_tables_that_are_kept_give_the_drivers_memory_back(spark, monkeypatch):
    from quillon.llm import frames

    beans = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean
    asked = []
    monkeypatch.setattr(frames, "trim", lambda: asked.append(beans().getHeapMemoryUsage().getUsed()))
    monkeypatch.setattr(frames, "_given_back", -1e9)
    kept = [frames.keep(spark.range(3), "give-back") for _ in range(2)]
    assert len(asked) == 1  # once, and not again for a while
    monkeypatch.setattr(frames, "_given_back", -1e9)
    assert frames.give_back(spark) and not frames.give_back(spark)
    frames.forget(*kept)


def test_tables_are_kept_without_starting_processes(spark, tmp_path):
    def started(run):
        """The commands of processes that the JVM started meanwhile, but for the one that all of its Python workers come from."""
        recording = spark._jvm.jdk.jfr.Recording()
        recording.enable("jdk.ProcessStart")
        recording.start()
        run()
        recording.stop()
        file = tmp_path / "recording.jfr"
        recording.dump(spark._jvm.java.io.File(str(file)).toPath())
        recording.close()
        commands = [e.getString("command") for e in spark._jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(spark._jvm.java.io.File(str(file)).toPath())]
        return [c for c in commands if "pyspark.daemon" not in c]

    rows = spark.range(2000, numPartitions=4).select("id", F.array("id", F.lit(None).cast("long")).alias("x"), (F.col("id") % 3 == 0).alias("third"), F.when(F.col("id") > 5, F.col("id").cast("int")).alias("i"))
    rows.write.parquet(str(tmp_path / "first"))  # what starts once
    rows.mapInArrow(lambda batches: batches, rows.schema).collect()
    kept = []
    assert not started(lambda: kept.extend((frames.keep_numbers(rows, "some"), frames.keep_numbers(rows.where("id < 0"), "none"))))
    assert kept[0].dtypes == rows.dtypes == kept[1].dtypes
    assert sorted(kept[0].collect()) == sorted(rows.collect()) and not kept[1].collect()
    frames.forget(*kept)
    assert not any(os.path.exists(k._kept.removeprefix("file://")) for k in kept)
    docs = documents(spark, random_texts(40, 45, 30))
    found = []
    assert not started(lambda: found.extend((neardup.clusters(docs).collect(), neardup.without_near_copies(docs).collect())))
    assert len(found[0]) == 40


def test_kept_tables_that_changed_on_the_store_are_not_read(spark):
    kept = frames.keep_numbers(spark.range(5000, numPartitions=1).select(F.xxhash64("id").alias("x")), "changed")
    (file,) = Path(kept._kept.removeprefix("file://")).glob("part-*")
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        kept.agg(F.sum("x")).collect()
    frames.forget(kept)
