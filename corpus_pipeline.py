"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents; the last
returns one row per piece of a packed document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, neardup, packing, quality, toxicity
from quillon.llm.frames import configure, forget, keep, table
from quillon.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    labels = table(spark, sf_dir, "labels")
    return toxicity.kept_documents(docs, labels.where(~toxicity.is_held_out()))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return neardup.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Trained models and sketches have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
