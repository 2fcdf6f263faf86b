"""What type a text column is meant to have, judged from its first values or from all of them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.assessments.profile import first_values
from scrubjay.functions import stats
from scrubjay.functions.columns import FALSE_WORDS, MISSING_MARKERS, TRUE_WORDS, dtype_of, is_missing, qcol, strip_ws
from scrubjay.functions.dates import DATE_FORMATS, DATETIME_SUFFIXES, TIME_FORMATS, full_year, spark_pattern
from scrubjay.session import ROW_ID

# What whole numbers, numbers and identifiers look like.
INTEGER = r"^-?\d{1,18}$"
DECIMAL = r"^-?\d{1,15}([.,]\d+)?$"
IDENTIFIERS = (r"^0\d+$", r"^\d{5}(-\d{4})?$", r"^\+?[\d\s\-().]{7,}$", r"^[A-Za-z]*\d{6,}$")

SAMPLE, DATE_SAMPLE, MOST_CATEGORIES = 300, 200, 50


#: The formats in the order in which they are tried, and their kinds.
FORMATS = [(f, "date") for f in DATE_FORMATS] + [(d + x, "datetime") for d in DATE_FORMATS for x in DATETIME_SUFFIXES] + [(f, "time") for f in TIME_FORMATS]


def _fits(value: str, fmt: str) -> bool:
    try:
        datetime.strptime(value, fmt)
    except ValueError:
        return False
    return True


def date_formats(values: list[str]) -> tuple[str | None, str | None, list[str], bool]:
    """Kind, format, values that fit none, and whether day and month could be either way round."""
    left, bad = None, []
    for value in list(dict.fromkeys(v.strip() for v in values))[:DATE_SAMPLE]:
        fitting = [x for x in FORMATS if any(c.isdigit() for c in value) and _fits(value, x[0])]
        shared = fitting if left is None else [x for x in left if x in fitting]
        if shared:
            left = shared
        else:
            bad.append(value)
    if not left:
        return None, None, bad, False
    fmt, kind = left[0]
    day_first, month_first = (any(f.startswith(p) for f, _ in left) for p in (("%d/%m", "%d-%m"), ("%m/%d", "%m-%d")))
    return kind, fmt, bad, day_first and month_first


def _shape(text: str) -> str:
    """A format or a text with one 9 for each run of digits, one a for each of letters."""
    return re.sub("[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", text))


def format_mask(c: Column) -> Column:
    """A bit for each of FORMATS that a text fits, 0 if it fits none.

    Only the formats of the text's own shape are tried, so a value costs a few
    attempts, whatever the number of formats.
    """
    text = strip_ws(c.cast("string"))
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), "[A-Za-z]+", "a")
    by_shape: dict[str, list[int]] = {}
    for bit, (fmt, _) in enumerate(FORMATS):
        # a T between date and time is a letter of its own, and %b and %B are words
        plain = re.sub("%[bB]", "a", re.sub("%[YmdHMSf]", "9", fmt))
        by_shape.setdefault(_shape(plain), []).append(bit)
    mask = F.lit(0).cast("long")
    for own, bits in by_shape.items():
        fits = [F.when(full_year(text, FORMATS[b][0], F.try_to_timestamp(text, F.lit(spark_pattern(FORMATS[b][0])))).isNotNull(), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in bits]
        mask = F.when(shape == own, reduce(lambda x, y: x.bitwiseOR(y), fits)).otherwise(mask)
    return mask


def column_formats(df: DataFrame, names: Iterable[str], markers: Iterable[str] = MISSING_MARKERS) -> dict[str, dict]:
    """Date formats of text columns by all their values: kind, format, how many values fit it and how many don't, examples of those.

    Values are counted first, so formats are tried once for each distinct one.
    One aggregate then counts the masks of all columns, a few hundred at most;
    the formats that fit the most frequent masks together are left, the first
    of them is the column's.
    """
    names, markers = list(names), list(markers)
    if not names:
        return {}
    cells = F.array(*(F.when(qcol(c).isNotNull(), F.struct(F.lit(i).alias("i"), qcol(c).cast("string").alias("v"))) for i, c in enumerate(names)))
    each = df.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.i", "c.v").agg(F.count("*").alias("n"))
    there = each.where(~is_missing(F.col("v"), markers)).select("i", "v", "n", format_mask(F.col("v")).alias("mask"))
    rows = there.groupBy("i", "mask").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest")).collect()
    out = {}
    for i, name in enumerate(names):
        masks = sorted(((r.n, r.mask, [r.least, r.greatest]) for r in rows if r.i == i), key=lambda x: (-x[0], x[1]))
        left = 0
        for _, mask, _ in masks:
            shared = mask if not left else left & mask
            left = shared or left
        bits = [b for b in range(len(FORMATS)) if left >> b & 1]
        fmt, kind = FORMATS[bits[0]] if bits else (None, None)
        fits = lambda mask: bool(bits) and bool(mask >> bits[0] & 1)  # noqa: E731, B023
        day_first, month_first = (any(FORMATS[b][0].startswith(p) for b in bits) for p in (("%d/%m", "%d-%m"), ("%m/%d", "%m-%d")))
        bad = [x for x in masks if not fits(x[1])]
        out[name] = {"kind": kind, "format": fmt, "n": sum(n for n, _, _ in masks), "n_misfits": sum(n for n, _, _ in bad), "misfits": sorted({v for _, _, examples in bad for v in examples})[:5], "ambiguous": day_first and month_first}
    return out


def categorical(n_unique: int, n: int) -> bool:
    return n_unique <= MOST_CATEGORIES and n_unique / n <= 0.5


def infer_values(values: list[str], n_unique: int, n: int) -> dict:
    """Suggested type of text values; ``n`` and ``n_unique`` are the whole column's."""
    m = len(values)
    words = {v.strip().lower() for v in values}
    if words <= {*TRUE_WORDS, *FALSE_WORDS}:
        return {"suggested": "boolean"}
    plain = [v.strip().replace(",", "") for v in values]
    whole = sum(bool(re.match(INTEGER, v)) for v in plain)
    if whole / m >= 0.95:
        alike = sum(any(re.match(p, v.strip()) for p in IDENTIFIERS) for v in values)
        if alike / m >= 0.8:
            return {"suggested": "string", "identifier_detected": True}
        return {"suggested": "integer", "compatible_pct": whole / m * 100, "incompatible_count": m - whole}
    real = sum(bool(re.match(DECIMAL, v.strip())) or bool(re.match(DECIMAL, p)) for v, p in zip(values, plain, strict=True))
    if real / m >= 0.95:
        return {"suggested": "decimal", "compatible_pct": real / m * 100, "incompatible_count": m - real}
    kind, fmt, bad, ambiguous = date_formats(values)
    seen = len(dict.fromkeys(v.strip() for v in values[:DATE_SAMPLE]))
    if kind and (seen - len(bad)) / max(seen, 1) >= 0.9:
        return {"suggested": kind, "date_format": fmt, "ambiguous_date_format": ambiguous, "incompatible_count": len(bad), "incompatible_examples": bad[:5], "compatible_pct": (seen - len(bad)) / seen * 100}
    return {"suggested": "categorical" if categorical(n_unique, n) else "string"}


def infer_columns(df: DataFrame, names: Iterable[str], markers: Iterable[str] = MISSING_MARKERS, whole: bool = False) -> dict[str, dict]:
    """Suggested type of columns: a column's own if it isn't text, else by its first 300 values.

    The first values of all text columns are read together, and their distinct
    values estimated by sketches in one pass; only a column whose estimate is
    next to the limits is counted.  ``whole`` judges dates by all values.
    """
    markers, out, texts = list(markers), {}, []
    for name in names:
        kind = dtype_of(df, name)
        suggested = next((x for types, x in (((T.BooleanType,), "boolean"), ((T.DateType,), "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.IntegralType,), "integer"), ((T.NumericType,), "decimal")) if isinstance(kind, types)), None)
        out[name] = {"column": name, "dtype": kind.simpleString(), "suggested": suggested or "string", "compatible_pct": 100.0, "incompatible_count": 0, "incompatible_examples": [], "ambiguous_date_format": False, "date_format": None, "identifier_detected": False}
        if suggested is None:
            texts.append(name)
    values = first_values(df.select(*([ROW_ID] if ROW_ID in df.columns else []), *(qcol(c).cast("string").alias(c) for c in texts)), texts, markers, SAMPLE)
    texts = [c for c in texts if values[c]]
    if texts:
        there = {c: F.when(~is_missing(qcol(c), markers), qcol(c).cast("string")) for c in texts}
        found = stats.estimates(stats.distinct_sketches(df, there))
        near = [c for c, (n, u) in found.items() if len({categorical(max(1, int(u * (1 + x)) + round(x * 50)), n) for x in (-stats.SKETCH_ERROR, 0, stats.SKETCH_ERROR)}) > 1]
        exact = stats.distinct_counts(df, {c: there[c] for c in near}) if near else {}
        for name, (n, unique) in found.items():
            unique = exact.get(name, unique)
            out[name] |= {"n_unique": unique, "n_values": n} | infer_values(values[name], unique, n)
        if whole:
            dated = [c for c in texts if out[c]["suggested"] in ("date", "datetime", "time", "string", "categorical")]
            for name, x in column_formats(df, dated, markers).items():
                if x["kind"] and 1 - x["n_misfits"] / x["n"] >= 0.9:
                    out[name] |= {"suggested": x["kind"], "date_format": x["format"], "ambiguous_date_format": x["ambiguous"], "incompatible_count": x["n_misfits"], "incompatible_examples": x["misfits"], "compatible_pct": (1 - x["n_misfits"] / x["n"]) * 100}
                elif out[name]["suggested"] in ("date", "datetime", "time"):  # the first values aren't like the rest
                    out[name] |= {"suggested": "categorical" if categorical(out[name]["n_unique"], out[name]["n_values"]) else "string", "date_format": None, "ambiguous_date_format": False, "compatible_pct": 100.0, "incompatible_count": 0, "incompatible_examples": []}
    return out


def infer_column(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """Suggested type of one column."""
    return infer_columns(df, [name], markers)[name]
