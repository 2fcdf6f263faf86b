"""What is in a table: profile, missing values, structure, column names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubjay.functions.columns import MISSING_MARKERS, all_of, folded, is_missing, is_numeric, is_text, missing_in, qcol, strip_ws, trimmed_number
from scrubjay.functions.columns import number as parsed_number
from scrubjay.session import ROW_ID, materialize

#: Non-missing values of a text column that are looked at for its type, in the order of the ids.
TYPE_SAMPLE = 300


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def long_form(df: DataFrame, columns: Iterable[str], extra: Column | None = None) -> DataFrame:
    """(column, value as text) rows for the columns, and the row's id if asked for."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")) for c in columns))
    own = [extra] if extra is not None else []
    return df.select(*own, F.explode(cells).alias("cell")).select(*(["__rid"] if own else []), "cell.*")


def missing_counts(df: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """(column, n_missing, n_rows): one pass over the table."""
    names = data_columns(df)
    row = df.agg(F.count("*").alias("n"), *(F.count_if(missing_in(df, c, markers)).alias(f"m{i}") for i, c in enumerate(names)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"), F.col("n").alias("n_rows")) for i, c in enumerate(names)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def marker_breakdown(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """(marker, n): nulls, blanks and each marker of a column, as they are counted missing."""
    c = qcol(name)
    kind = F.when(c.isNull(), F.lit("null value")).when(folded(c) == "", F.lit("blank")).otherwise(folded(c))
    return df.where(is_missing(c, markers)).groupBy(kind.alias("marker")).agg(F.count("*").alias("n"))


def first_values(df: DataFrame, names: list[str], markers: Iterable[str] = MISSING_MARKERS, most: int = TYPE_SAMPLE) -> dict[str, list]:
    """Of each column the first ``most`` values that aren't missing, in the order of the ids.

    The rows with the smallest ids are read once for all columns; only a
    column with so many missing values that they aren't enough is sought by
    itself.
    """
    markers = list(markers)
    there = lambda c: F.when(~missing_in(df, c, markers), qcol(c))
    found: dict[str, list] = {c: [] for c in names}
    sought = list(names)
    if ROW_ID in df.columns and names:
        low = df.agg(F.min(qcol(ROW_ID))).first()[0]
        if low is None:
            return found
        rows = df.where(qcol(ROW_ID) < low + 2 * most).select(qcol(ROW_ID), *(there(c).alias(f"c{i}") for i, c in enumerate(names))).collect()
        rows.sort(key=lambda r: r[0])
        for i, c in enumerate(names):
            found[c] = [r[i + 1] for r in rows if r[i + 1] is not None][:most]
        sought = [c for c in names if len(found[c]) < most]
    for c in sought:
        own = df.where(~missing_in(df, c, markers))
        found[c] = [r[0] for r in (own.orderBy(ROW_ID) if ROW_ID in df.columns else own).select(qcol(c)).limit(most).collect()]
    return found


def _suspects(df: DataFrame, names: list[str], markers: Iterable[str]) -> set[str]:
    """Text columns of which over nine tenths of the first values are numbers."""
    rows = [(c, v) for c, values in first_values(df, names, markers).items() for v in values]
    shares = df.sparkSession.createDataFrame(rows, "column string, value string").groupBy("column").agg(F.count(trimmed_number(F.col("value"))).alias("hits"), F.count("*").alias("n"))
    return {r.column for r in shares.collect() if r.hits / r.n > 0.9}


def _approximate(df: DataFrame, names: list[str], markers: list[str]) -> DataFrame:
    """(column, n_rows, n_missing, n_unique) in one pass without a shuffle of values."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        gone = missing_in(df, c, markers)
        aggs += [F.count_if(gone).alias(f"m{i}"), F.approx_count_distinct(F.when(~gone, qcol(c).cast("string")), 0.02).alias(f"u{i}")]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("n_missing"), F.col(f"u{i}").alias("n_unique")) for i, c in enumerate(names)))
    rows = df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    return rows.withColumn("n_unique", F.least("n_unique", F.col("n_rows") - F.col("n_missing")))


def profile(df: DataFrame, markers: Iterable[str] = MISSING_MARKERS, approximate: bool = False) -> DataFrame:
    """One row per column: missing values, distinct values, key and severity; worst first.

    Distinct values are counted by one shuffle of (column, value) counts,
    summed before the shuffle, for all columns together; ``approximate``
    estimates them in one pass instead, for tables where that shuffle is too
    much.
    """
    names = data_columns(df)
    markers = list(markers)
    if approximate:
        per = _approximate(df, names, markers)
    else:
        cells = F.array(*(F.struct(F.lit(c).alias("column"), missing_in(df, c, markers).alias("missing"), F.when(~missing_in(df, c, markers), qcol(c).cast("string")).alias("value")) for c in names))
        counts = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "missing", "value").agg(F.count("*").alias("n"))
        per = counts.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("n_missing"), F.count_if(~F.col("missing")).alias("n_unique"))
    suspects = _suspects(df, [c for c in names if is_text(df, c)], markers)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    table = df.sparkSession.createDataFrame([(c, kinds[c], c in suspects) for c in names], "column string, dtype string, suspect_numeric boolean")
    rows = table.join(per, "column", "left").na.fill(0, ["n_rows", "n_missing", "n_unique"])
    pct = F.when(F.col("n_rows") > 0, F.col("n_missing") * 100.0 / F.col("n_rows")).otherwise(0.0)
    rows = rows.withColumn("missing_pct", F.round(pct, 2)).withColumn("n_repeated", F.col("n_rows") - F.col("n_missing") - F.col("n_unique"))
    level = F.when(pct == 0, 0).when(pct < 25, 1).when(pct < 50, 2).when(pct < 75, 3).otherwise(4)
    level = F.when(F.col("suspect_numeric"), F.greatest(level, F.lit(2))).otherwise(level)
    severity = F.element_at(F.array(*map(F.lit, ("none", "low", "moderate", "high", "critical"))), level + 1)
    rows = rows.withColumns({"is_unique_key": (F.col("n_missing") == 0) & (F.col("n_repeated") == 0) & (F.col("n_rows") > 0), "has_repeats": F.col("n_repeated") > 0, "level": level, "severity": severity})
    return rows.orderBy(F.desc("level"), F.desc("missing_pct"), "column").drop("level")


def structures(df: DataFrame) -> dict:
    """Rows that are all null, columns without values, and columns with one value only."""
    names = data_columns(df)
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(all_of(qcol(c).isNull() for c in names)).alias("empty_rows"),
        *(F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(names)),
        *(F.min(qcol(c)).alias(f"a{i}") for i, c in enumerate(names)),
        *(F.max(qcol(c)).alias(f"b{i}") for i, c in enumerate(names)),
    ).first()
    empty = [c for i, c in enumerate(names) if not row[f"n{i}"]]
    constant = [c for i, c in enumerate(names) if row[f"n{i}"] and row[f"a{i}"] == row[f"b{i}"]]
    return {"n_rows": row.n, "empty_rows": row.empty_rows, "empty_columns": empty, "constant_columns": constant}


def proposed_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"


def column_names(df: DataFrame) -> list[dict]:
    """Proposed name and problems of each column; columns that would get one name collide."""
    names = data_columns(df)
    proposed = [proposed_name(c) for c in names]
    out = []
    for name, new in zip(names, proposed, strict=True):
        problems = [text for text, bad in (("surrounding spaces", name != name.strip()), ("upper case", name != name.lower()), ("special characters", bool(re.search(r"[^A-Za-z0-9_\s]", name))), ("spaces", bool(re.search(r"\s", name.strip()))), ("collision", proposed.count(new) > 1)) if bad]
        out.append({"column": name, "proposed": new, "problems": problems})
    return out


# Characters that aren't special.
USUAL = r"A-Za-z0-9\s\-.,'/:%"


def special_chars(df: DataFrame, samples: int = 3) -> DataFrame:
    """(column, char, n, samples): characters other than letters, digits and common marks in text columns.

    Each column's characters are summed before the shuffle; the samples are
    the first distinct values by id that hold the character.  Values are told
    apart by a hash, so a few bytes of each are shuffled, and only the rows of
    the samples are fetched.
    """
    names = [c for c in data_columns(df) if is_text(df, c)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, char string, n long, samples array<string>")
    cells = long_form(df, names, qcol(ROW_ID).alias("__rid"))
    found = F.array_distinct(F.regexp_extract_all("value", F.lit(f"([^{USUAL}])"), F.lit(1)))
    odd = cells.where(F.col("value").rlike(f"[^{USUAL}]")).withColumn("char", F.explode(found))
    often = F.length("value") - F.length(F.replace("value", F.col("char"), F.lit("")))
    seen = odd.groupBy("column", "char", F.md5(F.encode("value", "UTF-8")).alias("value")).agg(F.min("__rid").alias("first"), F.sum(F.floor(often / F.length("char"))).alias("n"))
    seen = materialize(seen, "special")
    counts = seen.groupBy("column", "char").agg(F.sum("n").alias("n"))
    shown = seen.withColumn("k", F.row_number().over(Window.partitionBy("column", "char").orderBy("first", "value"))).where(F.col("k") <= samples)
    shown = materialize(shown.select("column", "char", "k", F.col("first").alias("__rid")), "shown")  # a few rows of each character
    values = cells.join(shown.select("column", "__rid").distinct(), ["column", "__rid"]).select("column", "__rid", "value")
    lists = shown.join(values, ["column", "__rid"]).groupBy("column", "char").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    return counts.join(lists, ["column", "char"]).select("column", "char", "n", F.col("s.value").alias("samples"))


def _numbers(df: DataFrame, name: str) -> Column:
    return qcol(name).cast("double") if is_numeric(df, name) else trimmed_number(qcol(name))


def skewness(df: DataFrame, name: str) -> float | None:
    return df.agg(F.skewness(_numbers(df, name))).first()[0]


# Treatments by intended type.
METHODS_BY_TYPE = {
    "integer": ("constant", "mean", "median", "mode", "interpolate_linear", "interpolate_time", "group_impute", "random_sample"),
    "decimal": ("constant", "mean", "median", "mode", "interpolate_linear", "interpolate_time", "group_impute", "random_sample"),
    "categorical": ("mode", "constant", "group_impute", "random_sample"),
    "string": ("constant",),
    "date": ("forward_fill", "backward_fill", "constant", "interpolate_time"),
    "datetime": ("forward_fill", "backward_fill", "constant", "interpolate_time"),
    "time": ("forward_fill", "backward_fill", "constant"),
    "boolean": ("mode", "constant", "group_impute"),
}
ALWAYS = ("leave", "drop_rows", "drop_column")


def recommended(suggested: str, missing_pct: float, skew: float | None) -> str | None:
    """The treatment that fits a column's type, share of missing values and skew."""
    if missing_pct <= 0:
        return None
    if missing_pct >= 50:
        return "drop_column"
    if suggested in ("integer", "decimal"):
        return "median" if abs(skew or 0.0) >= 1.0 else "mean"
    if suggested in ("categorical", "boolean"):
        return "mode"
    return "forward_fill" if suggested in ("date", "datetime", "time") else "constant"


def missingness(df: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> list[dict]:
    """Per column with missing values: count, share, breakdown, type, examples, treatments, advice.

    A few jobs serve all columns: counts, first values, distinct values of the
    text columns, markers by column, skews.
    """
    from scrubjay.assessments.typing import infer_columns

    markers = list(markers)
    counts = {r.column: r for r in missing_counts(df, markers).collect()}
    names = list(counts)
    kinds = {c: x["suggested"] for c, x in infer_columns(df, names, markers).items()}
    shown = first_values(df, names, markers, 5)
    gone = [c for c in names if counts[c].n_missing]
    breakdown: dict[str, dict] = {c: {} for c in names}
    if gone:
        value = lambda c: F.when(qcol(c).isNull(), F.lit("null value")).when(folded(qcol(c)) == "", F.lit("blank")).otherwise(folded(qcol(c)))
        cells = F.array(*(F.when(missing_in(df, c, markers), F.struct(F.lit(c).alias("column"), value(c).alias("marker"))) for c in gone))
        for r in df.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.column", "c.marker").agg(F.count("*").alias("n")).collect():
            breakdown[r.column][r.marker] = r.n
    numeric = [c for c in gone if kinds[c] in ("integer", "decimal")]
    skews = dict(zip(numeric, df.agg(*(F.skewness(_numbers(df, c)) for c in numeric)).first(), strict=True)) if numeric else {}
    out = []
    for name in names:
        n, total = counts[name].n_missing, counts[name].n_rows
        pct = n / total * 100 if total else 0.0
        kind = kinds[name]
        out.append(
            {
                "column": name,
                "n_missing": n,
                "missing_pct": round(pct, 2),
                "breakdown": breakdown[name],
                "suggested": kind,
                "examples": shown[name],
                "methods": [*METHODS_BY_TYPE[kind], *ALWAYS],
                "recommended": recommended(kind, pct, skews.get(name)),
            }
        )
    return out


def unimputable_groups(df: DataFrame, name: str, group_by: list[str], markers: Iterable[str] = MISSING_MARKERS, most: int | None = None) -> DataFrame:
    """Groups in which a column has no value at all, in order; ``most`` makes it a report of the first ones."""
    there = F.count_if(~missing_in(df, name, markers)).alias("n_observed")
    found = df.groupBy(*(qcol(k) for k in group_by)).agg(F.count("*").alias("n_rows"), there).where("n_observed = 0").orderBy(*(qcol(k) for k in group_by))
    return found if most is None else found.limit(most)


def numeric_view(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> Column:
    """A column's numbers: missing values and texts that aren't numbers are null."""
    c = qcol(name)
    value = c.cast("double") if is_numeric(df, name) else parsed_number(strip_ws(c.cast("string")))
    return F.when(~missing_in(df, name, markers), value)

