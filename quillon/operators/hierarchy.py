"""Levels of a hierarchical dataset: expansion, wide samples, contracts, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import leaf_pattern


def children(parents: DataFrame, rows: DataFrame, parent: str = "id", child: str = "parent_id") -> DataFrame:
    """Parents with their children, 1:n."""
    return parents.join(rows, parents[parent] == rows[child])


def wide(rows: DataFrame, sample: str, leaf: str, value: str, leaves: list | None = None) -> DataFrame:
    """One row per sample and a column for each leaf; with the leaves given no extra pass finds them."""
    grouped = rows.groupBy(sample)
    return (grouped.pivot(leaf, leaves) if leaves is not None else grouped.pivot(leaf)).agg(F.first(f"`{value}`", ignorenulls=True))


def union_datasets(parts: dict[str, DataFrame], source: str = "dataset") -> DataFrame:
    """One level of many datasets, with a column that tells them apart; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(source, F.lit(name)) for name, df in parts.items()))


def contract_faults(samples: DataFrame, files: DataFrame, tree: list[str], fields: dict[str, str] | None = None, sample: str = "id", owner: str = "parent_id", name: str = "name") -> DataFrame:
    """Rows (sample, rule, found) for every breach of a contract.

    tree: leaves of a sample, fixed (B02.tif: exactly one) or variable (img*[4,16].tif: that many).
    fields: columns of samples with their types; a null there is a breach.  Counts are one aggregation over files.
    """
    rules = [(leaf, *leaf_pattern(leaf)) for leaf in tree]
    counts = files.groupBy(F.col(owner).alias("_owner")).agg(*(F.count_if(F.col(name).rlike(p)).alias(f"_{k}") for k, (_, p, _, _) in enumerate(rules)))
    joined = samples.join(counts, samples[sample] == counts["_owner"], "left")
    tests = []
    for k, (leaf, _, least, most) in enumerate(rules):
        n = F.coalesce(F.col(f"_{k}"), F.lit(0))
        tests.append(F.when(~n.between(least, most), F.struct(F.lit(leaf).alias("rule"), n.cast("string").alias("found"))))
    have = dict(samples.dtypes)
    for field, kind in (fields or {}).items():
        if have.get(field) != kind:
            tests.append(F.struct(F.lit(f"{field}: {kind}").alias("rule"), F.lit(have.get(field, "missing")).alias("found")))
        else:
            tests.append(F.when(F.col(field).isNull(), F.struct(F.lit(f"{field}: {kind}").alias("rule"), F.lit("null").alias("found"))))
    return joined.select(F.col(sample).alias("sample"), F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("t")).select("sample", "t.rule", "t.found")


def version_key(version: str | F.Column) -> F.Column:
    """A semantic version as an array that sorts like it (major, minor, patch)."""
    v = F.col(version) if isinstance(version, str) else version
    return F.transform(F.split(F.regexp_extract(v, r"^v?(\d+(\.\d+){0,2})", 1), r"\."), lambda p: p.cast("int"))
