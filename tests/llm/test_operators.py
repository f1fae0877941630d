"""Operators on small tables, against brute force."""

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, fingerprint, license, lm, neardup, packing, quality, toxicity, warc
from tests.llm.test_kernels import random_texts, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use themselves."""
    texts = ["", None, "   ", "a", "a", "b c", "w " * 30000, "x" * 50000, None, "a"]
    df = documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, None, 3])
    return df.selectExpr("*", "1 as score", "'q' as label", "0 as n", "1.5 as count", "'z' as key", "1 as row", "'r' as rep", "0 as tails", "1 as shard", "2 as expected_grade", "3 as sequence_id")


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets)}


def family(seed, n, rate, size=60):
    """Copies of one text at growing distances."""
    import random

    r = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(size)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, rate)):
            w[r.randrange(size)] = f"n{r.random()}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = random_texts(40, 1) + family(1, 60, 8) + family(2, 40, 3) + ["same text of a few words"] * 9 + ["Two words", "two  WORDS", "", None, " \n"]
    ids = [7 * i % 1009 for i in range(len(texts))]
    want, sizes = brute_components(ids, texts)
    got = {r["doc_id"]: r for r in neardup.clusters(documents(spark, texts, ids)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    kept = neardup.without_near_copies(documents(spark, texts, ids))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and {r[0] for r in kept.collect()} == set(want.values())


def test_near_duplicates_odd_rows(spark):
    rows = neardup.clusters(odd(spark)).collect()
    assert len(rows) == 10
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert by[4, 1] == 3 and by[0, 0] == 0 and by[1, 0] == 1 and by[None, 0] is None and by[6, 1] == 6
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in neardup.without_near_copies(odd(spark)).select("doc_id").collect()) == [(False, i) for i in (0, 1, 2, 3, 5, 6, 7)] + [(True, None)]
    assert neardup.clusters(odd(spark).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(df, "t").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == got[150] == 100 and all(got[k] == 500 for k in range(501, 560))


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    enc = packing.Encoder(path)
    texts = random_texts(60, 2, 400) + ["", None, "<|endoftext|> x", "word " * 5000]
    docs = documents(spark, texts)
    rows = packing.packed_documents(docs, path, 512).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*enc.plain.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in parts] == packing.piece_bounds(len(ids), 512)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in parts)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        ends = 0
        for o, n in sorted(parts):
            assert o == ends
            ends += n
        assert ends <= 512
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 512) + 1
    assert packing.packed_documents(odd(spark), path).count() > 10 and packing.packed_documents(docs.limit(0), path).count() == 0
    with_ids = packing.pieces(docs, path, 512, with_ids=True).where("doc_id = 0").orderBy("piece").collect()
    assert [x for r in with_ids for x in r["ids"]] == [*enc.encode(texts[0]), 0]


def test_chat_round_trip(spark):
    nasty = ["", None, r"\### Assistant: </turn> ok", "<next>", r"\l\s\g\\", "</turn>\n<turn user>", "é\U0001f600", "x" * 5000]
    rows = [(k % 3, k // 3, ["user", "assistant", "assistant", "a>b<\\", None][k % 5], nasty[k % len(nasty)]) for k in range(60)] + [(9, 1, "assistant", "t"), (9, 1, "assistant", "t"), (None, 0, "user", "n"), (9, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'x' as formatted", "2 as t")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r)[0], (r[2] or ""), (r[3] or "")))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["loss_text"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        roles = [r[2] or "" for r in own]
        assert got[conv]["n_blocks"] == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert all("<" not in chat_text for chat_text in [got[conv]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[conv]["loss_spans"]])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_warc(spark):
    long = "<p>" + "z" * 200000
    rows = [(k, f"http://h/{k}", ["same", None, "", f"own é {k}", long][k % 5]) for k in range(40)] + [(3, None, "again"), (3, None, "again"), (None, "u r\nl", "same"), (77, "x", "\x1f\x8b\x08 magic")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first", "3 as payload")
    files = warc.write(df.repartition(3), file_bytes=2000)
    assert files.count() > 3
    for cut in (137, 5000, 1 << 20):
        got = sorted(((r["page_id"] is None, r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, files, cut).collect()), key=str)
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
            revisit = page != first
            want.append((page is None, page, base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, len(data)))
        assert got == sorted(want, key=str)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, files).where("record_type = 'response'").collect()}
    assert payloads[4] == long and payloads[77] == "\x1f\x8b\x08 magic"
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_fingerprints(spark):
    texts = random_texts(2500, 3, 60) + ["", None, "only this", random_texts(1, 99, 900)[0]]
    ids = [(13 * k) % 5003 - 100 for k in range(len(texts))]
    docs = documents(spark, texts, ids).repartition(5)
    terms = fingerprint.lexicon(docs)
    df = Counter(w for t in texts for w in set(words(t)))
    assert len(terms) == sum(2 <= n <= len(texts) / 10 for n in df.values())
    rows = {r["doc_id"]: r for r in fingerprint.with_edited(docs, terms).collect()}
    assert len(rows) == len(texts)
    order = sorted(zip(ids, texts))
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        assert rows[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) <= (rows[i]["near_edited"] == 1.0)
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs, terms).collect()}
    assert alone == {i: r["fingerprint"] for i, r in rows.items()}
    one = fingerprint.neighbours(documents(spark, ["one two three four"], [5])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert len(fingerprint.neighbours(odd(spark)).collect()) == 10 and fingerprint.neighbours(odd(spark).limit(0)).count() == 0
    same = fingerprint.neighbours(odd(spark)).where("doc_id in (3, 4)").select("fingerprint").distinct().count()
    assert same == 1


def test_likeness_follows_common_terms(spark):
    vocabulary = [f"t{k}" for k in range(400)]
    texts = [" ".join(vocabulary[a : a + 200]) for a in (0, 20, 60, 200)]
    prints = fingerprint.Prints(np.sort(fingerprint.tk.words(*fingerprint.tk.column_bytes(fingerprint.pa.array([" ".join(vocabulary)])))[0]))
    p = prints.of(fingerprint.pa.array(texts))
    near = [fingerprint.likeness(p[0], x) for x in p]
    assert near[0] == 1 and near[1] > near[2] > near[3] and abs(near[1] - 180 / 220) < 0.25 and near[3] < 0.1


def test_lm_scores(spark):
    texts = random_texts(300, 4, 50) + ["", None, "é Zz"]
    docs = documents(spark, texts).repartition(4)
    held = F.col("doc_id") % 7 == 2
    rows = {r["doc_id"]: r for r in lm.scores(docs, held).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if i % 7 != 2:
            c.update(words(t))
            c["\0end"] += 1
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        tokens = [*words(t), "\0end"]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n, i % 7 == 2)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    known = sum(r["score"] for r in rows.values()) / sum(r["n_tokens"] for r in rows.values())
    assert known > -3
    assert lm.scores(docs.limit(0), held).count() == 0 and lm.scores(odd(spark), F.lit(False)).count() == 10
    none = lm.scores(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in none)


def test_lm_probabilities_sum_to_one(spark):
    docs = documents(spark, random_texts(200, 6, 40)).selectExpr("doc_id", "text", "false as held")
    table = lm.keep(lm.blocks(docs, 4), "t")
    counts = lm.keep(table.where(F.col("kind") == lm.GRAMS).repartition(4, "shard").sortWithinPartitions("shard", "block").mapInArrow(lm._gram_counts, "key long, n long"), "g")
    for rarest in (0.0, 1e-3):
        trie = lm.opened(lm.trie_file(counts, rarest))
        assert rarest == 0 or trie.child[-1].n < counts.count()
        for context in (b"\n" * (lm.ORDER - 1), b"\n" * (lm.ORDER - 2) + b"a", b"abcdeabcde"[: lm.ORDER - 1], b"\xff" * (lm.ORDER - 1), b" a b  a b "[: lm.ORDER - 1]):
            symbols = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
            total = (10 ** trie.log10(symbols)).sum()
            assert 0.97 < total < 1.001


def test_lm_scores_equal_interpolation(spark):
    texts = random_texts(60, 12, 30) + ["", "Qz qz", "rare \u017cubr", "aa aa aa"]
    seqs = [[lm.PAD] * (lm.ORDER - 1) + [*" ".join(words(t)).encode(), lm.END] for t in texts]
    n, contexts = Counter(), {}
    for i, s in enumerate(seqs):
        for j in range(lm.ORDER - 1, len(s)):
            for k in range(1, lm.ORDER + 1) if i % 5 else ():
                n[tuple(s[j - k + 1 : j + 1])] += 1
    for g, c in n.items():
        total, types = contexts.get((len(g), g[:-1]), (0, 0))
        contexts[len(g), g[:-1]] = total + c, types + lm.BACKOFF

    def p(g):
        if not g:
            return 1 / lm.SYMBOLS
        total, types = contexts.get((len(g), g[:-1]), (0, 0))
        return (n[g] + types * p(g[1:])) / (total + types) if total else p(g[1:])

    got = {r["doc_id"]: r["score"] for r in lm.scores(documents(spark, texts).repartition(3), F.col("doc_id") % 5 == 0).collect()}
    for i, s in enumerate(seqs):
        want = [math.log10(p(tuple(s[j - lm.ORDER + 1 : j + 1]))) for j in range(lm.ORDER - 1, len(s))]
        assert abs(got[i] - sum(want)) < 1e-3 * len(want)


def test_lm_keeps_rare_grams_of_large_corpora(spark):
    grams = [b"aaaaab", b"aaaaac", b"bcdefg"]
    counts = spark.createDataFrame([(int.from_bytes(g, "big"), c) for g, c in zip(grams, (1 << 40, 1, 1))], "key long, n long")
    assert lm.opened(lm.trie_file(counts)).child[-1].n == 3


def rated(spark):
    good, bad = random_texts(150, 7, 60), [t.upper() + " !! !!" for t in random_texts(150, 8, 60)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150), int(i % 2)) for i in range(300) if i % 3], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = rated(spark)
    model = quality.fit(docs, labels)
    rows = quality.graded(docs, model).withColumn("s", quality.selected(model, 1)).collect()
    assert sum(r["s"] == (r["doc_id"] < 150) for r in rows) > 290
    three = labels.selectExpr("doc_id", "case when doc_id < 100 then 5 when doc_id < 150 then 2 else 0 end as quality")
    m3 = quality.fit(docs, three)
    assert m3.grades.tolist() == [0, 2, 5] and (np.diff(m3.thresholds) > 0).all()
    r = quality.graded(docs, m3).first()
    assert 0 <= r["expected_grade"] <= 5 and r["tails"][0] >= r["tails"][1]
    assert quality.graded(odd(spark), model).count() == 10 and quality.graded(odd(spark), model).columns[:5] == odd(spark).columns[:5]
    for none in (labels.limit(0), labels.selectExpr("doc_id", "1 as quality"), labels.selectExpr("doc_id", "cast(null as int) as quality")):
        assert quality.kept_documents(docs, none).count() == 300 if none.count() and none.first()["quality"] else quality.graded(docs, quality.fit(docs, none)).count() == 300
    assert quality.kept_documents(docs, labels).columns == docs.columns and quality.kept_documents(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    texts = [t + (" vile rotten " if k % 4 == 0 else " ") + t for k, t in enumerate(random_texts(600, 9, 40))]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).where("doc_id >= 400").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows) > 190
    assert toxicity.fit(docs, labels).__dict__["kind"] == model.kind and abs(toxicity.fit(docs, labels).slope - model.slope) < 1e-9
    out = toxicity.scored(odd(spark), model)
    assert out.count() == 10 and out.columns[-1] == "score" and out.where("score is null").count() == 0
    for none in (labels.limit(0), labels.selectExpr("doc_id", "0 as toxic"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        s = {r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()}
        assert len(s) == 1 and next(iter(s)) <= 0.5
    kept = toxicity.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0 and doc_id >= 400").count() < 10


def test_class_models_are_distributions(spark):
    texts = random_texts(300, 10, 30)
    docs = documents(spark, texts).selectExpr("doc_id", "pmod(doc_id, 4) as fold", "cast(doc_id % 3 = 0 as int) as label", "text").withColumn("fold", F.col("fold").cast("int"))
    cells = docs.mapInArrow(toxicity._bigrams, "context long, word long, cell int, n long").groupBy("context", "word", "cell").agg(F.sum("n").cast("int").alias("n"))
    counts = toxicity.Gathered(cells.toArrow()).without(None)
    want = Counter()
    for i, t in enumerate(texts):
        w = words(t)
        want.update((a, b, i % 3 == 0) for a, b in zip([None, *w], w))
    assert counts.context_n.sum() == sum(want.values()) and counts.word_types.sum() == len(want)


def test_decontamination(spark):
    items = [" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[: 2 + j % 7] for j in range(40)) for k in range(5)]
    benchmark = spark.createDataFrame([*enumerate(items), (7, None), (8, "tiny"), (9, items[0])], "item_id long, text string")
    texts = ["clean words only here", items[1].upper(), f"before {items[2]} after", items[3][:40], None, ""]
    docs = documents(spark, texts)
    want = {0: [], 1: [1], 2: [2], 3: [], 4: [], 5: []}
    for block in (1 << 22, 300):
        got = {r["doc_id"]: r["benchmark_items"] for r in decontaminate.marked(docs, benchmark, block).collect()}
        assert got == want
    assert sorted(r[0] for r in decontaminate.clean_documents(docs, benchmark).collect()) == [0, 3, 4, 5]
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == 6 and decontaminate.clean_documents(docs.limit(0), benchmark).count() == 0
    assert decontaminate.marked(odd(spark), benchmark).count() == 10


def test_decontamination_reports_all_items_of_a_window(spark):
    first, second, third = (" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[:6] for j in range(40)) for k in "abc")
    rows = [(1, first), (2, first.upper()), (3, first + " " + second), (4, third), (None, third)]
    docs = documents(spark, [first, third, second])
    for block in (1 << 22, 300):
        got = {r["doc_id"]: r["benchmark_items"] for r in decontaminate.marked(docs, spark.createDataFrame(rows, "item_id long, text string"), block).collect()}
        assert got == {0: [1, 2, 3], 1: [-1, 4], 2: [3]}


def test_decontamination_finds_passages_wherever_they_begin(spark):
    item = " ".join(hashlib.md5(f"p{j}".encode()).hexdigest()[: 2 + j % 7] for j in range(60))
    around = " ".join(hashlib.md5(f"q{j}".encode()).hexdigest()[:5] for j in range(30))
    n = 64
    docs = documents(spark, [f"{around} {item[k : k + n]} {around}" for k in range(len(item) - n + 1)] + [around, f"{around} {item[100:140]} {around}"])
    rows = decontaminate.marked(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    clean = {len(rows) - 2, len(rows) - 1}
    assert all(r["benchmark_items"] == ([] if r["doc_id"] in clean else [5]) for r in rows)


def test_licences(spark):
    texts = random_texts(200, 11, 60)
    marks = {3: "Licensed under the Apache License, Version 2.0.", 9: "SPDX-License-Identifier: MIT", 20: "Licensed under CC BY-NC 4.0.", 30: "the license of the software is not known to the author of this text"}
    for k, m in marks.items():
        texts[k] = texts[k].replace("\n", " ") + "\n" + m + "\n" + texts[k]
    rows = {r["doc_id"]: [(x["family"], x["paragraph"]) for x in r["licences"] if x["confirmed"]] for r in license.scan(documents(spark, [*texts, None, ""])).collect()}
    assert rows[3] == [("apache", 1)] and rows[9] == [("mit", 1)] and rows[20] == [("cc-by-nc", 1)]
    assert sum(bool(x) for x in rows.values()) == 3 and len(rows) == 202
    assert license.scan(odd(spark)).count() == 10 and license.scan(odd(spark).limit(0)).count() == 0
