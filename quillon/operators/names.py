"""Unique names: the second a.txt becomes a-2.txt, unless an earlier row has that name, then a-3.txt, and so on."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.functions.expressions import suffixed

#: What suffixed() may have made: the last part's stem with numbers at its end.
_NUMBERED = r"^(.*/)?([^/]+?)((?:-\d+)+)(\.[^./]*)?$"


def family(name: Column) -> Column:
    """Names whose unique forms may meet: those that differ by numbers at the end of the stem alone."""
    return F.regexp_replace(name, _NUMBERED, "$1$2$4")


def add_suffix(name: str, k: int) -> str:
    """The k-th form of a name, as expressions.suffixed has it; the first is the name itself."""
    if k == 1:
        return name
    return re.sub(r"(?<=[^/])(\.[^./]*)?$", rf"-{k}\1", name, count=1) if name else f"-{k}"


def renamed(names: list[str]) -> list[str]:
    """Unique names of rows in order: each row takes the first form of its name that is free."""
    forms: dict[str, Iterator[str]] = {}  # of each name, those that were not tried yet
    taken: dict[str, None] = {}  # in order
    for name in names:
        left = forms.setdefault(name, map(functools.partial(add_suffix, name), itertools.count(1)))
        taken[next(form for form in left if form not in taken)] = None
    return list(taken)


def unique_names(rows: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Adds unique_name. Families without numbered names are ranked by a window; in the others numbers may be taken, and
    each is gone through in order by a task of its own."""
    marked = rows.withColumn("_family", family(F.col(name))).withColumn("_numbered", F.col(name).rlike(_NUMBERED))
    risky = marked.groupBy("_family").agg(F.max("_numbered").alias("_n"), F.count("*").alias("_c")).where("_n and _c > 1").select("_family")
    rank = F.row_number().over(W.partitionBy(name).orderBy(order))
    plain = marked.join(risky, "_family", "left_anti").withColumn("_k", rank)
    plain = plain.withColumn("unique_name", F.when(F.col("_k") == 1, F.col(name)).otherwise(suffixed(name, "_k"))).select(*rows.columns, "unique_name")

    columns = [*rows.columns, "unique_name"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        return part.assign(unique_name=renamed(part[name].tolist()))[columns]

    schema = StructType([*rows.schema, StructField("unique_name", StringType())])
    return plain.unionByName(marked.join(risky, "_family", "left_semi").groupBy("_family").applyInPandas(run, schema))
