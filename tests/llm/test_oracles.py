"""Parts of results that SQL can say, and fingerprints against a plain version."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import fingerprint, queries
from quillon.llm import textkit as tk
from tests.llm.test_kernels import random_texts, words

DATA = "/root/testdata/sf0.001"
M = (1 << 64) - 1


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def test_edited_texts_equal_sql(spark, duck):
    want = duck.execute("""
      with t as (select doc_id, coalesce(text, '') as text from documents), n as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as following from t)
      select doc_id, length(text), sha256(left(text, length(text) - length(text) // 4) || left(following, length(text) // 4)) from n order by doc_id""").fetchall()
    got = queries.op7_document_fingerprints(spark, DATA).orderBy("doc_id").select("doc_id", "n_chars", "edited_sha256").collect()
    assert [tuple(r) for r in got] == want


def test_packed_pieces_by_sql(spark, duck):
    pytest.importorskip("public_tokenizers")
    rows = queries.op10_best_fit_packing(spark, DATA).toArrow()
    duck.register("packed", rows)
    one = lambda q: duck.execute(q).fetchall()[0][0]
    assert one("select count(*) from documents where doc_id not in (select doc_id from packed)") == 0
    assert one("select count(*) from (select doc_id, piece, start, lag(start + length, 1, 0) over (partition by doc_id order by piece) as ends, row_number() over (partition by doc_id order by piece) - 1 as k from packed) where start <> ends or piece <> k") == 0
    assert one("select count(*) from (select \"offset\", lag(\"offset\" + length, 1, 0) over (partition by sequence_id order by \"offset\") as ends from packed) where \"offset\" <> ends") == 0
    assert one("select max(n) from (select sum(length) as n from packed group by sequence_id)") <= 2048
    assert one("select count(*) from packed p where piece > 0 and length <> 2048") == 0
    assert one("select count(distinct sequence_id) from packed") <= one("select ceil(sum(length) / 2048.0) from packed") + 2
    duck.unregister("packed")


def test_benchmark_windows_by_sql(spark, duck):
    """Every document that holds a window of an item as it stands is marked with it; SQL finds such windows without any edit."""
    want = duck.execute("""
      with normal as (select *, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g')) as n from documents),
      i as (select item_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g')) as n from benchmark),
      w as (select distinct item_id, substr(n, s + 1, 64) as w from i, range(0, 2000, 4) t(s) where strlen(n) = length(n) and s + 64 <= length(n))
      select doc_id, list_sort(list(distinct item_id)) from normal join w on contains(n, w) group by doc_id""").fetchall()
    got = {r["doc_id"]: set(r["benchmark_items"]) for r in queries.op1_benchmark_decontamination(spark, DATA).collect()}
    assert want and all(set(items) <= got[doc] for doc, items in want)


def mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def plain_print(text, lexicon):
    """(mark, j, hashes by rate and subset) with sets and whole numbers."""
    code = lambda w: int(tk.words(*tk.column_bytes(pa.array([w])))[0][0])
    own = {code(w) for w in words(text)}
    terms = own & lexicon or own
    if not terms:
        return "empty", -1, [[0] * fingerprint.SUBSETS] * 2
    j = max(math.floor(math.log2(len(terms) / fingerprint.AIM)), 0)
    out = []
    for s in (0, 1):
        row = []
        for k in range(fingerprint.SUBSETS):
            chosen = [h for h in terms if mix((h + 0x9E3779B97F4A7C15 * (k + 1)) & M) <= M >> (j + s)]
            total = sum(mix(h) | 1 for h in chosen) & M
            row.append(mix(total) >> 40 | 1 if total else 0)
        out.append(row)
    return ("t" if own & lexicon else "w"), j, out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best, share = 0, 0.0
    for s in (0, 1):
        for t in (0, 1):
            if a[0] == b[0] != "empty" and a[1] + s == b[1] + t:
                told = sum(x > 0 or y > 0 for x, y in zip(a[2][s], b[2][t]))
                if told > best:
                    n = fingerprint.SUBSETS
                    equal, empty = sum(x == y for x, y in zip(a[2][s], b[2][t])), max(n - told, 0.5)
                    empty = min(empty, n - 0.5)
                    best, share = told, 1 - math.log(max(equal, empty) / n) / math.log(empty / n)
    return min(1.0, max(0.0, share))


def test_fingerprints_equal_plain_ones():
    texts = random_texts(40, 51, 60) + ["", "  ", "one", "one two", "rare words of no lexicon"]
    texts += [t + " more" for t in texts[:10]]
    lexicon = {int(tk.words(*tk.column_bytes(pa.array([w])))[0][0]) for t in texts[:20] for w in words(t)[::2]}
    prints = fingerprint.Prints(np.array(sorted(lexicon), np.uint64))
    got = prints.of(pa.array(texts))
    want = [plain_print(t, lexicon) for t in texts]
    for (name, _, hashes), (mark, j, plain) in zip(got, want):
        assert hashes.tolist() == plain
        assert name == ("empty" if mark == "empty" else f"{mark}{j}:" + "".join(f"{x:06x}" for row in plain for x in row))
    for a in range(0, len(texts), 3):
        for b in range(len(texts)):
            assert abs(fingerprint.likeness(got[a], got[b]) - plain_likeness(want[a], want[b])) < 1e-9


def test_large_lexicons_stay_in_files(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(random_texts(300, 52, 40) + ["", None])], "doc_id long, text string").repartition(3)
    terms, files = fingerprint.lexicon(docs, 1.0), fingerprint.lexicon(docs, 1.0, most_terms=10, file_terms=7)
    assert len(terms) > 10 and isinstance(files, list) and len(files) > 1
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(fingerprint.with_edited(docs, terms)) == rows(fingerprint.with_edited(docs, files))
    assert rows(fingerprint.fingerprints(docs, terms)) == rows(fingerprint.fingerprints(docs, files))
