"""A look at a table: its first rows by id, size and types."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubjay.functions.columns import is_missing, qcol
from scrubjay.session import ROW_ID

MOST = 500


def preview(df: DataFrame, n: int = 20) -> dict:
    shown = df.orderBy(ROW_ID).limit(max(1, min(n, MOST))).collect()
    names = [c for c in df.columns if c != ROW_ID]
    return {"n_rows": df.count(), "n_columns": len(names), "dtypes": {c: t for c, t in df.dtypes if c != ROW_ID}, "rows": [{c: r[c] for c in names} for r in shown]}


def missing_rows(df: DataFrame, name: str, n: int = 10) -> list[dict]:
    """Some rows in which a column is missing."""
    return [r.asDict() for r in df.where(is_missing(qcol(name))).orderBy(ROW_ID).limit(max(1, min(n, 50))).collect()]
