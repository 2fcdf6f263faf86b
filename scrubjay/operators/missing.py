"""The treatments of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.functions import ordering, stats
from scrubjay.functions.columns import blank_to_null, dtype_of, float_text, is_temporal, is_text, markers_of, missing_in, number, number_or_comma, qcol, set_column
from scrubjay.operators.spec import operation
from scrubjay.session import ROW_ID

METHODS = ("drop_rows", "drop_column", "constant", "mean", "median", "mode", "forward_fill", "backward_fill", "interpolate_linear", "interpolate_time", "group_impute", "random_sample")


@operation("treat_missing")
def treat_missing(df: DataFrame, params: dict) -> DataFrame:
    """One of METHODS on a column; markers in text count as missing and become null."""
    name, method, markers = params["column"], params["method"], markers_of(params)
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "drop_column":
        return df.select(*(qcol(c) for c in df.columns if c != name))
    if method == "drop_rows":
        return df.where(~missing_in(df, name, markers))
    if is_text(df, name):
        df = set_column(df, name, blank_to_null(qcol(name), markers))
    if method in ("constant", "mean", "median", "mode"):
        return set_column(df, name, F.coalesce(qcol(name), _one_value(df, name, method, params)))
    if method in ("forward_fill", "backward_fill"):
        found = ordering.filled(_in_order(df, params), name, "__filled", method == "forward_fill")
        return set_column(found, name, F.col("__filled")).select(*map(qcol, df.columns))
    if method in ("interpolate_linear", "interpolate_time"):
        return _interpolated(df, name, method == "interpolate_time", params)
    if method == "group_impute":
        return _by_group(df, name, params)
    return _from_observed(df, name, int(params.get("seed", 0)), params.get("rows_per_bucket", ordering.ROWS_PER_BUCKET))


def _in_order(df: DataFrame, params: dict) -> ordering.Ordered:
    return ordering.in_buckets(df, ROW_ID, params.get("order_by"), params.get("rows_per_bucket", ordering.ROWS_PER_BUCKET))


def _one_value(df: DataFrame, name: str, method: str, params: dict) -> Column:
    """The constant, or the column's statistic, as a value of the column's type."""
    kind = dtype_of(df, name)
    if method == "constant":
        value = F.lit(params["value"]).try_cast(kind)
        if df.sparkSession.range(1).select(value.isNull()).first()[0]:
            raise ValueError(f"{params['value']!r} is no value for {name}")
        return value
    if method == "mode":
        found = stats.mode_smallest(df, name)
    else:
        values = df.select((number_or_comma(qcol(name)) if is_text(df, name) else qcol(name).cast("double")).alias("v"))
        found = values.agg(F.avg("v")).first()[0] if method == "mean" else stats.median(values, "v")
    if found is None:
        raise ValueError(f"{name} has no values to take a {method} of")
    return float_text(F.lit(found)) if is_text(df, name) and method != "mode" else F.lit(found).try_cast(kind)


def _interpolated(df: DataFrame, name: str, by_time: bool, params: dict) -> DataFrame:
    """Linear between the known values around a gap; nothing beyond the first and last."""
    order_by = params.get("order_by")
    value = number(qcol(name)) if is_text(df, name) else qcol(name).cast("double")
    rows = set_column(df, name, value)
    if rows.where(qcol(name).isNotNull()).limit(2).count() < 2:
        return df
    ordered = _in_order(rows, params)
    placed = ordering.with_position(ordered)
    position = F.col(ordering.POSITION).cast("double")
    if by_time and order_by and is_temporal(df, order_by):
        seconds = qcol(order_by).cast("timestamp").cast("double")
        position = F.coalesce(seconds, position)
    known = F.when(qcol(name).isNotNull(), F.struct(position.alias("p"), qcol(name).alias("v")))
    placed = placed.withColumn("__p", position).withColumn("__known", known)
    placed = ordering.filled(ordered.with_frame(placed), "__known", "__before", True)
    placed = ordering.filled(ordered.with_frame(placed), "__known", "__after", False)
    p, a, b = F.col("__p"), F.col("__before"), F.col("__after")
    gap = b["p"] - a["p"]
    between = F.when(gap == 0, a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (p - a["p"]) / F.when(gap != 0, gap))
    return set_column(placed, name, F.coalesce(qcol(name), between)).select(*map(qcol, df.columns))


def _by_group(df: DataFrame, name: str, params: dict) -> DataFrame:
    """The statistic of a row's group; rows without a group key, and of groups without values, stay missing."""
    keys, statistic, out = list(params["group_by"]), params.get("statistic", "median"), "__stat"
    text = is_text(df, name)
    value = number(qcol(name)) if text else qcol(name)
    if statistic == "mode":
        found = stats.group_mode(df, keys, name, out)
    elif statistic == "median":
        found = stats.group_median(df, keys, value.cast("double"), out)
    elif statistic in ("mean", "min", "max"):
        found = df.groupBy(*(qcol(k) for k in keys)).agg({"mean": F.avg, "min": F.min, "max": F.max}[statistic](value).alias(out))
    else:
        raise ValueError(f"unknown statistic: {statistic}")
    found = found.select(*(qcol(k).alias(f"__k{i}") for i, k in enumerate(keys)), out)
    joined = df.join(found, [qcol(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
    fill = F.col(out)
    if text and statistic != "mode":
        fill = float_text(fill.cast("double"))
    filled = F.coalesce(qcol(name), fill).alias(name)
    return joined.select(*(filled if c == name else qcol(c) for c in df.columns))


def _from_observed(df: DataFrame, name: str, seed: int, rows_per_bucket: int) -> DataFrame:
    """A value drawn from all observed ones, by a hash of the row's id and the seed.

    The observed values are numbered in the order of the ids; a missing row
    takes the number that its hash leaves, and only missing rows are joined.
    The draw is the same however the rows are partitioned.
    """
    there = df.where(qcol(name).isNotNull())
    n = there.count()
    if not n:
        return df
    numbered = ordering.with_position(ordering.in_buckets(there.select(ROW_ID, qcol(name)), ROW_ID, None, rows_per_bucket))
    values = numbered.select(F.col(ordering.POSITION).alias("__at"), qcol(name).alias("__drawn"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", qcol(ROW_ID).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long") % n
    gone = df.where(qcol(name).isNull()).withColumn("__at", draw).join(values, "__at")
    return there.unionByName(gone.select(*(F.col("__drawn").alias(name) if c == name else qcol(c) for c in df.columns)))
