"""The result against the original: missing cells, doubles, changed cells and rows.

Both sides are compared by digests of ranges of ids first; only the rows of
ranges that differ are joined and compared cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.assessments.keys import key_summary
from scrubjay.assessments.profile import data_columns
from scrubjay.functions.columns import MISSING_MARKERS, any_of, float_text, missing_in, qcol
from scrubjay.session import ROW_ID, materialize


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each group alike in all columns."""
    names = data_columns(df)
    groups = df.groupBy(*(qcol(c) for c in names)).agg(F.count("*").alias("n"))
    return int(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0])


def _text(df: DataFrame, name: str) -> Column:
    return float_text(qcol(name)) if dict(df.dtypes)[name] in ("double", "float") else qcol(name).cast("string")


#: Rows with neighbouring ids whose digests are taken together.
RANGE = 4096


def range_digests(df: DataFrame, columns: list[str], rows: int = RANGE) -> DataFrame:
    """(range, n, d, e): for each range of ids the number of rows, and 128 bits of digest over ids and values as text.

    Rows are summed before the shuffle, so a range costs some bytes for each
    part that holds it, however wide the rows are.
    """
    values = [x for c in columns for x in (qcol(c).isNull(), _text(df, c))]
    hashed = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), qcol(ROW_ID), *values))
    return df.groupBy(F.floor(qcol(ROW_ID) / rows).alias("range")).agg(F.count("*").alias("n"), hashed(1).alias("d"), hashed(2).alias("e"))


def differing_ranges(before: DataFrame, after: DataFrame, columns: list[str], rows: int = RANGE) -> DataFrame:
    """(range): those in which the two differ in a row or a value; written, so that its size is known to the joins."""
    one, two = (range_digests(df, columns, rows) for df in (before, after))
    joined = one.alias("x").join(two.alias("y"), "range")
    same = (F.col("x.n") == F.col("y.n")) & (F.col("x.d") == F.col("y.d")) & (F.col("x.e") == F.col("y.e"))
    return materialize(joined.where(~same).select("range"), "ranges")


def _side_by_side(before: DataFrame, after: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows that are in both, of the ranges that differ; all others are known to be alike."""
    shared = [c for c in data_columns(before) if c in data_columns(after)]
    ranges = differing_ranges(before, after, shared)
    of = lambda df: df.join(ranges, F.floor(qcol(ROW_ID) / RANGE) == F.col("range"), "left_semi")
    a = of(before).select(ROW_ID, *(_text(before, c).alias(f"a{i}") for i, c in enumerate(shared)))
    b = of(after).select(qcol(ROW_ID).alias("__other"), *(_text(after, c).alias(f"b{i}") for i, c in enumerate(shared)))
    return a.join(b, F.col(ROW_ID) == F.col("__other")), shared


def _differs(i: int) -> Column:
    return ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, n_changed) over the rows that are in both; values are compared as text, nulls alike."""
    joined, shared = _side_by_side(before, after)
    if not shared:
        return before.sparkSession.createDataFrame([], "column string, n_changed long")
    row = joined.agg(*(F.count_if(_differs(i)).alias(f"n{i}") for i in range(len(shared))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_changed")) for i, c in enumerate(shared)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def change_totals(before: DataFrame, after: DataFrame) -> tuple[int, int]:
    """Changed cells, and rows with one, in one aggregate."""
    joined, shared = _side_by_side(before, after)
    if not shared:
        return 0, 0
    each = sum((F.when(_differs(i), 1).otherwise(0) for i in range(len(shared))), F.lit(0))
    cells, rows = joined.agg(F.coalesce(F.sum(each), F.lit(0)), F.count_if(any_of(_differs(i) for i in range(len(shared))))).first()
    return int(cells), int(rows)


def preview(before: DataFrame, after: DataFrame, most: int = 10) -> dict:
    """A dry run's result: sizes, affected rows (a frame of ids) and a few rows before and after."""
    joined, shared = _side_by_side(before, after)
    changed = joined.where(any_of(_differs(i) for i in range(len(shared)))) if shared else joined.where(F.lit(False))
    shown = changed.orderBy(ROW_ID).limit(most).collect()
    return {
        "rows_before": before.count(),
        "rows_after": after.count(),
        "columns_before": data_columns(before),
        "columns_after": data_columns(after),
        "affected": changed.select(ROW_ID),
        "examples": [{"row_id": r[ROW_ID], "before": {c: r[f"a{i}"] for i, c in enumerate(shared)}, "after": {c: r[f"b{i}"] for i, c in enumerate(shared)}} for r in shown],
    }


def _sizes(df: DataFrame, markers: Iterable[str]) -> tuple[int, int]:
    """Rows and missing cells, in one pass."""
    gone = sum((missing_in(df, c, markers).cast("long") for c in data_columns(df)), F.lit(0).cast("long"))
    n, missing = df.agg(F.count("*"), F.coalesce(F.sum(gone), F.lit(0))).first()
    return n, missing


def figures(original: DataFrame, working: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """What both frames have to be read for; it stays as long as the operations do."""
    markers = list(markers)
    cells, rows = change_totals(original, working)
    (n0, missing0), (n1, missing1) = _sizes(original, markers), _sizes(working, markers)
    names0, names1 = data_columns(original), data_columns(working)
    return {
        "rows_before": n0,
        "rows_after": n1,
        "rows_removed": n0 - n1,
        "columns_removed": [c for c in names0 if c not in names1],
        "columns_added": [c for c in names1 if c not in names0],
        "missing_before": missing0,
        "missing_after": missing1,
        "duplicates_before": duplicate_rows(original),
        "duplicates_after": duplicate_rows(working),
        "cells_changed": cells,
        "rows_changed": rows,
    }


def key_figures(working: DataFrame, key: list[str], markers: Iterable[str] = MISSING_MARKERS) -> dict:
    return key_summary(working, key, markers).first().asDict()


def validate(original: DataFrame, working: DataFrame, key: list[str] | None = None, unresolved_outliers: int = 0, states: dict | None = None, applied: int = 0, undone: int = 0, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """The summary that goes with a result, and what to be warned of."""
    return summary(figures(original, working, markers), key, key_figures(working, key, markers) if key else None, unresolved_outliers, states, applied, undone)


def summary(measured: dict, key: list[str] | None = None, key_found: dict | None = None, unresolved_outliers: int = 0, states: dict | None = None, applied: int = 0, undone: int = 0) -> dict:
    """validate's result from figures and key_figures."""
    out = measured | {
        "outliers_unresolved": unresolved_outliers,
        "operations_applied": applied,
        "operations_undone": undone,
        "stage_states": states or {},
    }
    warnings = []
    if key:
        out["key"] = {"columns": key, **key_found, "holds": key_found["missing_rows"] == key_found["identical_groups"] == key_found["conflicting_groups"] == 0}
        if not out["key"]["holds"]:
            warnings.append("the declared key doesn't hold")
    if unresolved_outliers:
        warnings.append(f"{unresolved_outliers} outliers without a decision")
    warnings += [f"stage {k} is outdated" for k, v in (states or {}).items() if v == "outdated"]
    return out | {"warnings": warnings}
