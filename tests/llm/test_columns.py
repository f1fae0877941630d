"""Columns of every name go through the operators unchanged."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, fingerprint, license, lm, neardup, packing, quality, toxicity, warc
from tests.llm.test_kernels import random_texts

NAMES = [
    ["_text", "score", "tails", "expected_grade", "benchmark_items", "row", "h", "root", "c0", "label", "n", "key"],
    ["Score", "TAILS", "Benchmark_Items", "Row", "C0", "_a", "_b", "a b", "x.y", "win", "items", "grade"],
]


@pytest.fixture(scope="module", params=NAMES, ids=["plain", "other"])
def docs(request, spark):
    texts = [t + (" vile rotten scum " if k % 4 == 0 else " ") * 3 for k, t in enumerate(random_texts(60, 21, 40))]
    texts += ["", None, texts[0], "passage " + ITEM]
    rows = [(k, t, *(k * 100 + j for j in range(len(request.param)))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in request.param)).repartition(3)


ITEM = " ".join(f"benchmark{k}word" for k in range(30))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 4 == 0), int(k % 4 != 0)) for k in range(50)], "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(3, ITEM)], "item_id long, text string")


def values(df):
    return {r[0]: tuple(r) for r in df.collect()}


def test_filters_return_original_values(docs, labels, benchmark):
    before = values(docs)
    kept = [toxicity.kept_documents(docs, labels), quality.kept_documents(docs, labels), decontaminate.clean_documents(docs, benchmark), neardup.without_near_copies(docs)]
    for df in kept:
        assert df.columns == docs.columns and df.schema == docs.schema
        after = values(df)
        assert 0 < len(after) < len(before) or df is kept[1]
        assert all(before[k] == row for k, row in after.items())
    assert 63 not in values(kept[2]) and 62 not in values(kept[3])


def test_results_stand_beside_all_other_columns(docs, labels, benchmark):
    model, grades = toxicity.fit(docs, labels), quality.fit(docs, labels)
    before = values(docs)
    for df, names in (
        (toxicity.scored(docs, model, "quillon_score"), ["quillon_score"]),
        (quality.graded(docs, grades, "quillon_grade", "quillon_tails"), ["quillon_grade", "quillon_tails"]),
        (decontaminate.marked(docs, benchmark, name="quillon_items"), ["quillon_items"]),
        (decontaminate.marked(docs, benchmark, 500, "quillon_items"), ["quillon_items"]),
    ):
        assert df.columns == docs.columns + names
        assert {k: row[: len(docs.columns)] for k, row in values(df).items()} == before
    for df, new in ((toxicity.scored(docs, model), ["score"]), (quality.graded(docs, grades), ["expected_grade", "tails"]), (decontaminate.marked(docs, benchmark), ["benchmark_items"])):
        others = [c for c in docs.columns if c.lower() not in new]
        assert df.columns == others + new
        assert {r[0]: tuple(r[c] for c in others) for r in df.collect()} == {r[0]: tuple(r[c] for c in others) for r in docs.collect()}


def test_tables_of_ids_ignore_other_columns(spark, docs):
    n = docs.count()
    assert neardup.clusters(docs).count() == license.scan(docs).count() == n
    assert lm.scores(docs, F.lit(False)).count() == fingerprint.neighbours(docs).count() == n
    P = pytest.importorskip("public_tokenizers")
    assert packing.packed_documents(docs, P.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == n
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))
    assert warc.read(spark, warc.write(pages)).count() == n


def test_repeated_names(spark, labels, benchmark):
    docs = spark.createDataFrame([(k, t, k + 0.5, -k) for k, t in enumerate(random_texts(20, 22, 20))], "doc_id long, text string, score double, other long").toDF("doc_id", "text", "score", "score")
    for df in (toxicity.kept_documents(docs, labels.limit(0)), decontaminate.clean_documents(docs, benchmark), neardup.without_near_copies(docs)):
        assert df.columns == docs.columns and {tuple(r) for r in df.collect()} <= {tuple(r) for r in docs.collect()}


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (3, b), (5, b + " end"), (7, c), (7, c), (9, a)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"]) for r in neardup.clusters(docs).collect())
    assert rows == [(3, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    assert sorted(tuple(r) for r in neardup.without_near_copies(docs).collect()) == [(3, a), (3, b), (7, c)]


def test_samples_bound_rows_and_not_ids(spark, labels):
    many = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('text number ', id) as text")
    rows = toxicity.labelled_texts(many, labels, "toxic", 100)
    assert rows.count() == 3
    assert len(license.background(many.selectExpr("cast(doc_id as long) as doc_id", "text"), 2)) == 2
