"""The pipeline and the queries against what they are made of."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm.frames import table
from tests.llm.test_operators import brute_components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, DATA, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], DATA).cache())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_every_stage_against_brute_force(spark, stages):
    texts = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in stages[:5]]
    assert all(set(b) <= set(a) for a, b in zip(texts, texts[1:]))
    root, _ = brute_components(list(texts[2]), list(texts[2].values()))
    assert set(texts[3]) == set(root.values())
    items = [" ".join("".join(ch if ch.isalnum() else " " for ch in r["text"].lower()).split()) for r in table(spark, DATA, "benchmark").collect()]
    plain = {i: " ".join("".join(ch if ch.isalnum() else " " for ch in t.lower()).split()) for i, t in texts[3].items()}
    dirty = {i for i, t in plain.items() if any(x in t for x in items)}
    assert dirty.isdisjoint(texts[4]) and len(texts[3]) - len(texts[4]) <= len(dirty) + 2
    assert {r["doc_id"] for r in stages[5].collect()} == set(texts[4])


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, stages[5].collect()))


def test_empty_and_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", None, "s", 1), (3, "w " * 20000, "en", "s", 40000)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            d = f(spark, d, DATA)
            d.count()


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
