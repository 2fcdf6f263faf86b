"""Operations on whole rows and columns: rename, drop, fill, correct, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.functions import stats
from scrubjay.functions.columns import as_number, dtype_of, is_text, qcol, set_column, trimmed_number
from scrubjay.operators.spec import operation
from scrubjay.session import ROW_ID

#: Ids listed in a plan; more become a table that is joined.
MANY_IDS = 1_000


def _rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    for name in mapping:
        if name not in df.columns:
            raise ValueError(f"unknown column: {name}")
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns would have the same name")
    return df.select(*(qcol(c).alias(n) for c, n in zip(df.columns, names, strict=True)))


@operation("rename_column", row_local=True)
def rename_column(df: DataFrame, params: dict) -> DataFrame:
    return _rename(df, {params["from"]: params["to"]})


@operation("rename_columns", row_local=True)
def rename_columns(df: DataFrame, params: dict) -> DataFrame:
    """All at once, so two columns may swap names."""
    return _rename(df, params["mapping"])


Ids = list[int] | DataFrame


def ids_of(df: DataFrame, params: dict) -> Ids:
    """The rows that an operation is about: a list of ids, or a table of them by its path."""
    if params.get("row_table"):
        return df.sparkSession.read.parquet(params["row_table"]).select(ROW_ID).distinct()
    return list(params["row_ids"])


def ids_frame(df: DataFrame, row_ids: Ids) -> DataFrame:
    if isinstance(row_ids, DataFrame):
        return row_ids
    return df.sparkSession.createDataFrame([(int(i),) for i in set(row_ids)], f"{ROW_ID} long")


def _listed(row_ids: Ids) -> bool:
    return isinstance(row_ids, list) and len(row_ids) <= MANY_IDS


def without_rows(df: DataFrame, row_ids: Ids) -> DataFrame:
    """Rows but for those of the ids; unknown ids change nothing."""
    if _listed(row_ids):
        return df.where(~qcol(ROW_ID).isin(row_ids)) if row_ids else df
    return df.join(ids_frame(df, row_ids), ROW_ID, "left_anti").select(*map(qcol, df.columns))


def only_rows(df: DataFrame, row_ids: Ids) -> DataFrame:
    if _listed(row_ids):
        return df.where(qcol(ROW_ID).isin(row_ids)) if row_ids else df.where(F.lit(False))
    return df.join(ids_frame(df, row_ids), ROW_ID, "left_semi").select(*map(qcol, df.columns))


@operation("drop_rows", row_local=True)
def drop_rows(df: DataFrame, params: dict) -> DataFrame:
    return without_rows(df, ids_of(df, params))


@operation("drop_column", row_local=True)
def drop_column(df: DataFrame, params: dict) -> DataFrame:
    dtype_of(df, params["column"])
    return df.select(*(qcol(c) for c in df.columns if c != params["column"]))


@operation("fill_null_constant", row_local=True)
def fill_null_constant(df: DataFrame, params: dict) -> DataFrame:
    """Real nulls only; markers stay."""
    name = params["column"]
    return set_column(df, name, F.coalesce(qcol(name), F.lit(params["value"]).cast(dtype_of(df, name))))


def _in_rows(df: DataFrame, name: str, row_ids: Ids, value: Column) -> DataFrame:
    """A column changed in the rows of the ids only."""
    if _listed(row_ids):
        target = qcol(ROW_ID).isin(row_ids) if row_ids else F.lit(False)
        return set_column(df, name, F.when(target, value).otherwise(qcol(name)))
    marked = df.join(ids_frame(df, row_ids).withColumn("__target", F.lit(True)), ROW_ID, "left")
    changed = F.when(F.col("__target"), value).otherwise(qcol(name)).alias(name)
    return marked.select(*(changed if c == name else qcol(c) for c in df.columns))


@operation("treat_rows")
def treat_rows(df: DataFrame, params: dict) -> DataFrame:
    """Reviewed rows: set missing, set a value, cap, or the column's mean, median or mode.

    The statistic is over all values, those of the treated rows too.
    """
    name, method, ids = params["column"], params["method"], ids_of(df, params)
    kind, c = dtype_of(df, name), qcol(name)
    if method == "missing":
        return _in_rows(df, name, ids, F.lit(None).cast(kind))
    if method == "value":
        return _in_rows(df, name, ids, F.lit(params["value"]).try_cast(kind))
    if method == "cap":
        x = as_number(df, name)
        capped = x
        if params.get("min") is not None:
            capped = F.when(x < params["min"], F.lit(float(params["min"]))).otherwise(capped)
        if params.get("max") is not None:
            capped = F.when(x > params["max"], F.lit(float(params["max"]))).otherwise(capped)
        return _in_rows(df, name, ids, capped.try_cast(kind))
    if method not in ("mean", "median", "mode"):
        raise ValueError(f"unknown method: {method}")
    values = df.select((trimmed_number(c) if is_text(df, name) else c).alias("v"))
    if method == "mean":
        value = values.agg(F.avg("v")).first()[0]
    else:
        value = stats.median(values, "v") if method == "median" else stats.mode_smallest(values, "v")
    literal = F.lit(value)
    return _in_rows(df, name, ids, literal.cast("string") if is_text(df, name) else literal)


@operation("merge_records")
def merge_records(df: DataFrame, params: dict) -> DataFrame:
    """Chosen values go to the primary row, the rows merged away are dropped."""
    primary = params["primary_row_id"]
    for name, value in (params.get("field_values") or {}).items():
        df = set_column(df, name, F.when(qcol(ROW_ID) == primary, F.lit(value).cast(dtype_of(df, name))).otherwise(qcol(name)))
    return without_rows(df, list(params.get("drop_row_ids") or []))
