"""Whether columns make a key: missing parts, repeats that agree, repeats that conflict."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubjay.assessments.profile import data_columns
from scrubjay.functions.columns import MISSING_MARKERS, any_of, missing_in, qcol


def key_groups(df: DataFrame, columns: list[str], markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """One row per repeated key: its columns, n_rows, and the names of the columns in which its rows differ.

    Smallest and largest value (and nulls beside values) tell whether a
    column differs, so a hot key is summed before it is shuffled.
    """
    there = df.where(~any_of(missing_in(df, c, markers) for c in columns))
    others = [c for c in data_columns(df) if c not in columns]
    aggs = [F.count("*").alias("__n")]
    for i, c in enumerate(others):
        aggs += [F.min(qcol(c)).alias(f"__a{i}"), F.max(qcol(c)).alias(f"__b{i}"), F.count(qcol(c)).alias(f"__c{i}")]
    groups = there.groupBy(*(qcol(c) for c in columns)).agg(*aggs).where("__n > 1")
    differs = lambda i: (F.col(f"__a{i}") != F.col(f"__b{i}")) | ((F.col(f"__c{i}") > 0) & (F.col(f"__c{i}") < F.col("__n")))
    names = F.array_compact(F.array(*(F.when(differs(i), F.lit(c)) for i, c in enumerate(others)))) if others else F.array().cast("array<string>")
    return groups.select(*(qcol(c) for c in columns), F.col("__n").alias("n_rows"), names.alias("conflicts"))


def key_summary(df: DataFrame, columns: list[str], markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """One row: total, missing, unique rows, and groups that repeat alike or in conflict."""
    if not columns:
        raise ValueError("a key needs a column")
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"unknown column: {c}")
    gone = any_of(missing_in(df, c, markers) for c in columns)
    rows = df.agg(F.count("*").alias("total_rows"), F.count_if(gone).alias("missing_rows"))
    groups = key_groups(df, columns, markers).agg(
        F.count_if(F.size("conflicts") == 0).alias("identical_groups"),
        F.count_if(F.size("conflicts") > 0).alias("conflicting_groups"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("__repeated"),
    )
    joined = rows.crossJoin(F.broadcast(groups))  # one row each
    return joined.select("total_rows", "missing_rows", "identical_groups", "conflicting_groups", (F.col("total_rows") - F.col("missing_rows") - F.col("__repeated")).alias("unique_rows"))


def key_conflicts(df: DataFrame, columns: list[str], markers: Iterable[str] = MISSING_MARKERS, most: int = 50, values: int = 5) -> list[dict]:
    """A report of ``most`` conflicting keys: the columns that differ, with ``values`` of their values each, as text."""
    found = key_groups(df, columns, markers).where(F.size("conflicts") > 0).orderBy(*(qcol(c) for c in columns)).limit(most).collect()
    if not found:
        return []
    names = [f"__k{i}" for i in range(len(columns))]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, columns, strict=True))
    reported = df.sparkSession.createDataFrame([(*(r[c] for c in columns), i, list(r.conflicts)) for i, r in enumerate(found)], f"{kinds}, __i int, __conflicts array<string>")
    others = [c for c in data_columns(df) if c not in columns]
    rows = df.join(F.broadcast(reported), [qcol(c) == F.col(n) for c, n in zip(columns, names, strict=True)])  # ``most`` rows
    cells = F.array(*(F.struct(F.lit(c).alias("c"), qcol(c).cast("string").alias("v")) for c in others))
    distinct = rows.select("__i", F.explode(F.filter(cells, lambda x: F.array_contains("__conflicts", x["c"]))).alias("x")).select("__i", "x.*").distinct()
    first = Window.partitionBy("__i", "c").orderBy("v")
    shown: dict = {}
    for r in distinct.withColumn("k", F.row_number().over(first)).where(F.col("k") <= values).orderBy("__i", "c", "k").collect():
        shown.setdefault((r["__i"], r.c), []).append(r.v)
    return [{"key": {c: r[c] for c in columns}, "n_rows": r.n_rows, "conflicts": list(r.conflicts), "values": {c: shown.get((i, c), []) for c in r.conflicts}} for i, r in enumerate(found)]


def missing_key_rows(df: DataFrame, columns: list[str], markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    return df.where(any_of(missing_in(df, c, markers) for c in columns))
