"""Outliers: bounds of a column, rows beyond them, and whether another column explains them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.assessments.profile import data_columns, numeric_view
from scrubjay.functions import ordering, stats
from scrubjay.functions.columns import MISSING_MARKERS, dtype_of, is_numeric, is_text, missing_in, qcol
from scrubjay.operators.rows_columns import ids_frame
from scrubjay.session import ROW_ID, scratch_path

# Defaults of the methods and limits of a context.
DEFAULTS = {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5, "percentile": (1, 99)}
MAD_SCALE = 0.6745
MIN_GROUP, MOST_MISSING_PCT = 10, 40
SAMPLE, SAMPLE_SEED = 3000, 42
WINDOW = 10

EXPLAINED, UNUSUAL, INSUFFICIENT = "explained_by_context", "still_unusual", "insufficient_evidence"


def values_of(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    return df.select(numeric_view(df, name, markers).alias("v")).where(F.col("v").isNotNull())


def column_stats(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """count, min, max, mean, median, std, q1, q3, iqr and skew (of the population)."""
    v = values_of(df, name, markers)
    row = v.agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.skewness("v").alias("skew"), stats.around_quantiles("v", [0.25, 0.75, 0.5, 0.5]).alias("around")).first()
    if not row["count"]:
        raise ValueError(f"{name} has no numbers")
    n = row["count"]
    q1, q3, low, high = stats.at_ranks(v, "v", [int((n - 1) * 0.25 + 0.5), int((n - 1) * 0.75 + 0.5), (n - 1) // 2, n // 2], n=n, around=row["around"])
    return {k: x for k, x in row.asDict().items() if k != "around"} | {"median": (low + high) / 2, "q1": q1, "q3": q3, "iqr": q3 - q1}


def bounds(df: DataFrame, name: str, method: str = "iqr", params: dict | None = None, markers: Iterable[str] = MISSING_MARKERS, found: dict | None = None) -> tuple[float, float]:
    """Lower and upper bound; what lies strictly beyond is flagged."""
    params, v = params or {}, values_of(df, name, markers)
    if method == "manual":
        low, high = params.get("min"), params.get("max")
        if low is None and high is None:
            raise ValueError("manual bounds need a min or a max")
        return (float("-inf") if low is None else float(low), float("inf") if high is None else float(high))
    if method == "percentile":
        low, high = params.get("lower", DEFAULTS[method][0]), params.get("upper", DEFAULTS[method][1])
        return tuple(stats.quantiles_nearest(v, "v", [low / 100, high / 100]))
    s = found or column_stats(df, name, markers)
    if method == "iqr":
        k = params.get("multiplier", DEFAULTS[method])
        return s["q1"] - k * s["iqr"], s["q3"] + k * s["iqr"]
    if method == "zscore":
        k = params.get("threshold", DEFAULTS[method])
        return s["mean"] - k * s["std"], s["mean"] + k * s["std"]
    if method == "modified_zscore":
        k = params.get("threshold", DEFAULTS[method])
        mad = stats.median(v.select(F.abs(F.col("v") - F.lit(s["median"])).alias("v")), "v")
        return (s["min"], s["max"]) if not mad else (s["median"] - k * mad / MAD_SCALE, s["median"] + k * mad / MAD_SCALE)
    raise ValueError(f"unknown method: {method}")


def flagged(df: DataFrame, name: str, low: float, high: float, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """(row id, value) of the rows beyond the bounds."""
    v = numeric_view(df, name, markers)
    return df.select(ROW_ID, v.alias("value")).where((F.col("value") < low) | (F.col("value") > high))


def screen(df: DataFrame, name: str, method: str = "iqr", params: dict | None = None) -> dict:
    """Stats, bounds, count, share, histogram and the flagged rows as a frame; treatments stay locked until a review."""
    s = column_stats(df, name)
    low, high = bounds(df, name, method, params, found=s)
    rows = flagged(df, name, low, high)
    n, total = rows.count(), df.count()
    return {"column": name, "method": method, "params": params or {}, "stats": s, "bounds": {"lower": low, "upper": high}, "outlier_count": n, "outlier_pct": round(n / total * 100, 2) if total else 0.0, "flagged": rows, "histogram": stats.histogram(values_of(df, name), "v"), "treatments_enabled": False}


# --- contexts ----------------------------------------------------------------


def contexts(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS, outcome: str | None = None) -> list[dict]:
    """Columns that may explain a column's outliers, the declared outcome first, then by usable pairs.

    One pass counts for all columns, one makes sketches of their distinct
    values; only columns next to a limit, and those that may hold groups, are
    counted by value.
    """
    names = [c for c in data_columns(df) if c != name]
    if not names:
        return []
    own = ~missing_in(df, name, markers)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        usable = own & ~missing_in(df, c, markers)
        length = F.avg(F.length(qcol(c).cast("string")))
        aggs += [F.count_if(missing_in(df, c, markers)).alias(f"m{i}"), F.count_if(usable).alias(f"u{i}"), F.count(numeric_view(df, c, markers)).alias(f"x{i}"), length.alias(f"l{i}")]
    row = df.agg(*aggs).first()
    if not row.n:
        return []
    there = {c: qcol(c) for c in names}
    found = stats.estimates(stats.distinct_sketches(df, there))
    near = [c for c, (n, u) in found.items() if u >= (1 - stats.SKETCH_ERROR) * (row.n - 2) or (is_text(df, c) and abs(u / max(n, 1) - 0.5) < stats.SKETCH_ERROR)]
    exact = stats.distinct_counts(df, {c: there[c] for c in near}) if near else {}
    unique = {c: exact.get(c, u) for c, (_, u) in found.items()}
    out, grouped = [], []
    for i, c in enumerate(names):
        values = unique[c]
        distinct = values + (found[c][0] < row.n)  # null is one more
        if row[f"m{i}"] / row.n * 100 > MOST_MISSING_PCT or distinct >= row.n - 1 or values <= 1 or row[f"u{i}"] < 2:
            continue
        if is_text(df, c) and (row[f"l{i}"] or 0) > 40 and values / max(1, row.n - row[f"m{i}"]) > 0.5:
            continue
        kind = dtype_of(df, c)
        if is_numeric(df, c) or (is_text(df, c) and row[f"x{i}"] / max(row[f"u{i}"], 1) > 0.9):
            what, why = "numeric", "numeric association possible"
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)):
            what, why = "datetime", "temporal order may explain extremes"
        elif isinstance(kind, T.BooleanType) or values == 2:
            what, why = "boolean", "two groups to compare"
        else:
            what, why = "categorical", ""
            grouped.append(c)
        out.append({"column": c, "kind": what, "reason": why, "usable_pairs": row[f"u{i}"], "is_outcome": c == outcome})
    if grouped:  # only these are counted by value
        cells = F.array(*(F.struct(F.lit(c).alias("c"), qcol(c).cast("string").alias("v")) for c in grouped))
        counts = df.select(F.explode(cells).alias("x")).select("x.*").groupBy("c", "v").agg(F.count("*").alias("n"))
        groups = {r.c: r.groups for r in counts.where(F.col("n") >= MIN_GROUP).groupBy("c").agg(F.count("*").alias("groups")).collect()}
        out = [x | {"reason": f"{groups[x['column']]} groups of {MIN_GROUP} rows or more"} if x["column"] in groups else x for x in out if x["column"] not in grouped or x["column"] in groups]
    return sorted(out, key=lambda e: (not e["is_outcome"], -e["usable_pairs"], e["column"]))


def _pairs(df: DataFrame, name: str, context: str, flags: DataFrame, markers: Iterable[str]) -> DataFrame:
    """Row id, y (the column), x (the context as it is) and whether the row is flagged, where both are there."""
    there = df.where(~missing_in(df, name, markers) & ~missing_in(df, context, markers))
    rows = there.select(ROW_ID, numeric_view(df, name, markers).alias("y"), qcol(context).alias("x"))
    return rows.join(flags.select(ROW_ID, F.lit(True).alias("flag")), ROW_ID, "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def _evidence(flags: DataFrame, judged: DataFrame) -> DataFrame:
    """(row id, status) for every flagged row; rows that weren't judged have too little evidence."""
    return flags.select(ROW_ID).join(judged, ROW_ID, "left").select(ROW_ID, F.coalesce("status", F.lit(INSUFFICIENT)).alias("status"))


def _status(explained: Column) -> Column:
    return F.when(explained, F.lit(EXPLAINED)).otherwise(F.lit(UNUSUAL))


def numeric_review(df: DataFrame, name: str, context: str, flags: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """Correlation, and a trend of the context on the column from the rows that aren't flagged.

    A flagged row is explained if its residual is within three standard
    deviations of the upper middle residual.
    """
    pairs = _numeric_pairs(df, name, context, flags, markers)
    plain = ~F.col("flag")
    row = pairs.agg(F.corr("y", "x").alias("r"), F.count("*").alias("n"), F.count_if(plain).alias("k"), F.regr_slope(F.when(plain, F.col("x")), F.when(plain, F.col("y"))).alias("b"), F.regr_intercept(F.when(plain, F.col("x")), F.when(plain, F.col("y"))).alias("a"), F.avg(F.when(plain, F.col("x"))).alias("mean")).first()
    slope = intercept = 0.0
    if row.k >= 3:
        slope = row.b or 0.0
        intercept = row.a if row.b is not None else row["mean"]
    residual = F.col("x") - (F.lit(slope) * F.col("y") + F.lit(intercept))
    rest = pairs.where(plain).select(residual.alias("v"))
    spread = rest.agg(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).first()[0]
    middle = stats.at_rank(rest, "v", row.k // 2) if row.k else 0.0
    near = 3 * spread if spread else 1e-6 * max(1.0, abs(middle))
    judged = pairs.where("flag").select(ROW_ID, _status(F.abs(residual - F.lit(middle)) <= near).alias("status"))
    correlation = None if row.n < 3 or row.r is None or row.r != row.r else row.r
    return {"kind": "numeric", "usable_pairs": row.n, "correlation": correlation, "trend": {"slope": slope, "intercept": intercept}, "evidence": _evidence(flags, judged)}


def _numeric_pairs(df: DataFrame, name: str, context: str, flags: DataFrame, markers: Iterable[str]) -> DataFrame:
    rows = df.select(ROW_ID, numeric_view(df, name, markers).alias("y"), numeric_view(df, context, markers).alias("x")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.join(flags.select(ROW_ID, F.lit(True).alias("flag")), ROW_ID, "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def datetime_review(df: DataFrame, name: str, context: str, flags: DataFrame, markers: Iterable[str] = MISSING_MARKERS, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> dict:
    """A flagged row is explained if it lies within the middle half of the 21 values around it in time."""
    pairs = _pairs(df, name, context, flags, markers)
    n = pairs.count()
    placed = ordering.with_position(ordering.in_buckets(pairs, ROW_ID, "x", rows_per_bucket))
    near = ordering.around(placed, WINDOW, lambda w: {"__w": F.array_sort(F.collect_list("y").over(w))})
    size = F.size("__w")
    at = lambda q: F.element_at("__w", F.floor(size * q).cast("int") + 1)
    judged = near.where("flag").select(ROW_ID, (_status(F.col("y").between(at(0.25), F.element_at("__w", F.least(size - 1, F.floor(size * 0.75).cast("int")) + 1))) if n >= MIN_GROUP else F.lit(INSUFFICIENT)).alias("status"))
    return {"kind": "datetime", "usable_pairs": n, "evidence": _evidence(flags, judged)}


def rolling_band(df: DataFrame, name: str, context: str, markers: Iterable[str] = MISSING_MARKERS, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> DataFrame:
    """(row id, y, median, low, high) of the 21 values around each row in the context's order."""
    rows = df.where(~missing_in(df, name, markers) & qcol(context).isNotNull()).select(ROW_ID, numeric_view(df, name, markers).alias("y"), qcol(context).alias("x"))
    placed = ordering.with_position(ordering.in_buckets(rows, ROW_ID, "x", rows_per_bucket))
    near = ordering.around(placed, WINDOW, lambda w: {"__w": F.array_sort(F.collect_list("y").over(w))})
    size = F.size("__w")
    at = lambda i: F.element_at("__w", i.cast("int") + 1)
    return near.select(ROW_ID, "y", at(F.floor(size / 2)).alias("median"), at(F.floor(size * 0.25)).alias("low"), at(F.least(size - 1, F.floor(size * 0.75))).alias("high"))


def group_review(df: DataFrame, name: str, context: str, flags: DataFrame, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """A flagged row is explained if it lies within its group's fences; groups under 10 rows tell nothing."""
    pairs = _pairs(df, name, context, flags, markers)
    groups = stats.group_quantiles(pairs, ["x"], F.col("y"))
    groups = groups.withColumn("iqr", F.col("q3") - F.col("q1"))
    judged = pairs.where("flag").join(groups.where(F.col("n") >= MIN_GROUP), "x").select(ROW_ID, _status(F.col("y").between(F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr"))).alias("status"))
    kind = "boolean" if isinstance(dtype_of(df, context), T.BooleanType) else "categorical"
    return {"kind": kind, "usable_pairs": pairs.count(), "groups": groups.withColumnRenamed("x", "value"), "evidence": _evidence(flags, judged)}


def review(df: DataFrame, name: str, context: str, flags: DataFrame | list[int], markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """Evidence for each flagged row from one context column."""
    rows = ids_frame(df, flags) if isinstance(flags, list) else flags
    kind = dtype_of(df, context)
    numeric = is_numeric(df, context)
    if is_text(df, context):
        usable, numbers = df.where(~missing_in(df, name, markers) & ~missing_in(df, context, markers)).agg(F.count("*"), F.count(numeric_view(df, context, markers))).first()
        numeric = numbers / max(usable, 1) > 0.9
    make = numeric_review if numeric else datetime_review if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)) else group_review
    out = make(df, name, context, rows, markers)
    return {"column": name, "context": context, "insufficient_evidence": out["usable_pairs"] < MIN_GROUP} | out


def visual_sample(df: DataFrame, x: str, y: str, flags: DataFrame, most: int = SAMPLE, seed: int = SAMPLE_SEED) -> DataFrame:
    """A picture's rows: ``most`` drawn by a hash of the id and the seed, and every flagged row."""
    marked = df.select(ROW_ID, qcol(x).alias("x"), qcol(y).alias("y")).join(flags.select(ROW_ID, F.lit(True).alias("flag")), ROW_ID, "left")
    rest = marked.where(F.col("flag").isNull()).orderBy(F.md5(F.concat_ws(":", F.col(ROW_ID).cast("string"), F.lit(str(seed)))), ROW_ID).limit(most)
    return rest.unionByName(marked.where("flag")).select(ROW_ID, "x", "y", F.coalesce("flag", F.lit(False)).alias("flagged"))


# --- decisions ---------------------------------------------------------------

DECISIONS = ("valid_extreme", "likely_error", "needs_review", "excluded")
TREATMENTS = ("keep", "remove", "set_missing", "cap", "impute", "correct")


class OutlierLog:
    """Flags, evidence and decisions per column; a plain record that goes to JSON.

    What a screen or a review finds is a table, kept by its path under
    ``folder``; a person's own lists of ids are kept as they are.  A decision
    holds for ids, or for all flagged rows that have none of their own.
    """

    def __init__(self, data: dict | None = None, folder: str | None = None, changed: Callable[[], None] | None = None):
        self.data, self.folder = data or {"outcome": None, "columns": {}}, folder
        self._changed = changed or (lambda: None)  # called behind each change

    def _column(self, name: str) -> dict:
        return self.data["columns"].setdefault(name, {"flagged": [], "flagged_table": None, "n_flagged": 0, "reviewed": False, "evidence": [], "decisions": {}, "decision_of_all": None})

    def _write(self, df: DataFrame, what: str) -> str:
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}.parquet" if self.folder else scratch_path(df.sparkSession, what)
        df.write.parquet(path)
        return path

    def declare_outcome(self, name: str, kind: str) -> None:
        self.data["outcome"] = {"column": name, "kind": kind}
        self._changed()

    def flag(self, name: str, rows: list[int] | DataFrame) -> None:
        """Flag ids, or all rows of a table of ids."""
        own = self._column(name)
        if isinstance(rows, DataFrame):
            path = self._write(rows.select(ROW_ID).distinct(), "flagged")
            own |= {"flagged": [], "flagged_table": path, "n_flagged": rows.sparkSession.read.parquet(path).count()}
        else:
            own |= {"flagged": sorted(rows), "flagged_table": None, "n_flagged": len(rows)}
        self._changed()

    def flagged_rows(self, spark: SparkSession, name: str) -> DataFrame:
        own = self._column(name)
        if own["flagged_table"]:
            return spark.read.parquet(own["flagged_table"])
        return spark.createDataFrame([(i,) for i in own["flagged"]], f"{ROW_ID} long")

    def add_evidence(self, name: str, context: str, status: dict[int, str] | DataFrame) -> None:
        """A review's (row id, status) rows, or a small dict of them."""
        own = self._column(name)
        own["reviewed"] = True
        if isinstance(status, DataFrame):
            own["evidence"].append({"context": context, "table": self._write(status.select(ROW_ID, "status"), "evidence")})
        else:
            own["evidence"] += [{"row_id": int(i), "context": context, "status": s} for i, s in sorted(status.items())]
        self._changed()

    def decide(self, name: str, ids: list[int] | None, decision: str) -> None:
        """Decide on some rows, or (None) on all flagged ones without a decision."""
        if decision not in DECISIONS:
            raise ValueError(f"unknown decision: {decision}")
        if ids is None:
            self._column(name)["decision_of_all"] = decision
        else:
            self._column(name)["decisions"] |= {str(i): decision for i in ids}
        self._changed()

    def keep_all(self, name: str) -> None:
        own = self._column(name)
        own["decisions"] = {}
        self.decide(name, None, "valid_extreme")

    def _unresolved(self, own: dict, spark: SparkSession | None) -> int:
        open_ids = {int(i) for i, d in own["decisions"].items() if d == "needs_review"}
        done = {int(i) for i in own["decisions"]} - open_ids
        settled = own["decision_of_all"] not in (None, "needs_review")
        if not own["flagged_table"]:
            flagged = {int(i) for i in own["flagged"]}
            return len(flagged & open_ids) if settled else len(flagged - done)
        named = open_ids if settled else done
        if not named:
            return 0 if settled else own["n_flagged"]
        spark = spark or SparkSession.active()
        hits = spark.read.parquet(own["flagged_table"]).join(spark.createDataFrame([(i,) for i in named], f"{ROW_ID} long"), ROW_ID).count()
        return hits if settled else own["n_flagged"] - hits

    def unresolved(self, name: str | None = None, spark: SparkSession | None = None) -> int:
        """Flagged rows without a decision."""
        own = [self._column(name)] if name else self.data["columns"].values()
        return sum(self._unresolved(c, spark) for c in own)

    def treatment(self, name: str, ids: list[int] | None, how: str, params: dict | None = None) -> tuple[str, dict] | None:
        """The operation that a treatment of some or (None) all flagged rows records; locked until the column is reviewed or the rows are decided."""
        own = self._column(name)
        if how not in TREATMENTS:
            raise ValueError(f"unknown treatment: {how}")
        undecided = own["decision_of_all"] is None and (ids is None or any(str(i) not in own["decisions"] for i in ids))
        if not own["reviewed"] and undecided:
            raise ValueError("review the outliers before treating them")
        if how == "keep":
            return None
        rows = {"row_table": own["flagged_table"]} if ids is None and own["flagged_table"] else {"row_ids": own["flagged"] if ids is None else ids}
        if how == "remove":
            return "drop_rows", rows
        method = {"set_missing": "missing", "cap": "cap", "correct": "value"}.get(how) or (params or {}).get("statistic", "median")
        return "treat_rows", {"column": name, **rows, "method": method, **(params or {})}
