"""Column builders shared by operations and assessments.  None runs Python per row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as missing, true and false (compared trimmed and lower-cased).
MISSING_MARKERS = ("na", "n/a", "null", "none", "nan", "-", "--", "")
TRUE_WORDS = ("y", "yes", "true", "t", "1")
FALSE_WORDS = ("n", "no", "false", "f", "0")

_SPACE = r"\p{IsWhite_Space}"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
_DECIMAL_COMMA = r"^-?\d+,\d+\z"


def qcol(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"unknown column: {name}")


def is_text(df: DataFrame, name: str) -> bool:
    """Whether a column holds plain text; a categorical column doesn't count."""
    field = next((f for f in df.schema.fields if f.name == name), None)
    if field is None:
        raise ValueError(f"unknown column: {name}")
    return isinstance(field.dataType, T.StringType) and field.metadata.get("logical") != "categorical"


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType))


def set_column(df: DataFrame, name: str, value: Column, metadata: dict | None = None) -> DataFrame:
    """The frame with one column replaced in its place."""
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    new = value.alias(name, metadata=metadata) if metadata else value.alias(name)
    return df.select(*(new if c == name else qcol(c) for c in df.columns))


def markers_of(params: dict | None) -> tuple[str, ...]:
    """Markers of a call, or the usual ones."""
    own = (params or {}).get("markers")
    return MISSING_MARKERS if own is None else tuple(str(m).strip().lower() for m in own)


def strip_ws(c: Column) -> Column:
    """Text without Unicode white space at either end."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def folded(c: Column) -> Column:
    """Value as text, trimmed and lower-cased."""
    return F.lower(strip_ws(c.cast("string")))


def is_missing(c: Column, markers: Iterable[str] = MISSING_MARKERS) -> Column:
    """Null, or a text that is a marker once trimmed and lower-cased; never null."""
    markers = list(markers)
    return c.isNull() | F.coalesce(folded(c).isin(markers), F.lit(False)) if markers else c.isNull()


def missing_in(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> Column:
    """is_missing of a frame's column; numbers, dates and truth values are only made text if a marker could be one."""
    c, kind, markers = qcol(name), dtype_of(df, name), list(markers)
    plain = isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType))
    if not plain or any(any(x.isdigit() for x in m) or m in ("true", "false", "infinity", "-infinity") for m in markers):
        return is_missing(c, markers)
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) and "nan" in markers else c.isNull()


def blank_to_null(c: Column, markers: Iterable[str] = MISSING_MARKERS) -> Column:
    """Text with markers made null."""
    return F.when(~is_missing(c, markers), c)


def number(c: Column) -> Column:
    """Double of a text that is wholly a number; null otherwise."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER) | F.lower(text).isin("inf", "-inf"), text.try_cast("double"))


def trimmed_number(c: Column) -> Column:
    return number(strip_ws(c.cast("string")))


def number_or_comma(c: Column) -> Column:
    """Number of a text, a decimal comma allowed."""
    text = strip_ws(c.cast("string"))
    return F.coalesce(number(text), F.when(text.rlike(_DECIMAL_COMMA), number(F.replace(text, F.lit(","), F.lit(".")))))


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: cast if it is a number, parsed if it is text."""
    return qcol(name).cast("double") if is_numeric(df, name) else trimmed_number(qcol(name))


def to_bool(c: Column) -> Column:
    word = folded(c)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def replace_first(c: Column, old: str, new: str) -> Column:
    """Text with the first occurrence of a literal replaced."""
    at = F.instr(c, old)
    return F.when(at > 0, F.overlay(c, F.lit(new), at, F.lit(len(old)))).otherwise(c)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.substr(c, F.lit(1), F.greatest(F.lit(0), F.length(c) - len(suffix)))).otherwise(c)


def zfill(c: Column, width: int) -> Column:
    """Zeros in front up to a width, behind a sign; never cut."""
    sign = F.when(c.rlike(r"^[+-]"), F.substr(c, F.lit(1), F.lit(1))).otherwise(F.lit(""))
    rest = F.regexp_replace(c, r"^[+-]", "")
    return F.when(F.length(c) >= width, c).otherwise(F.concat(sign, F.lpad(rest, F.lit(width) - F.length(sign), F.lit("0"))))


def title_case(c: Column) -> Column:
    """First letter of each run of letters and digits in upper case, the rest in lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), "")


def float_text(c: Column) -> Column:
    """A double as text without an exponent where it is a whole number below 1e15 (``30.0``)."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def with_row_id(df: DataFrame, name: str = "__rid") -> DataFrame:
    """The frame with dense 0-based ids in the order of its partitions, for files their order in the file.

    Spark numbers rows within a partition; one count per partition, which is
    all that reaches the driver, gives each partition's first id.  The frame
    must split the same way each time, as scans of files do; write others
    first.
    """
    marked = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__own"))
    first, total = [], 0
    for row in sorted(marked.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        first.append((row["__part"], total))
        total += row.n
    offsets = df.sparkSession.createDataFrame(first, "__at int, __first long")
    joined = marked.join(F.broadcast(offsets), F.col("__part") == F.col("__at"))  # a row per partition
    own = F.col("__own").bitwiseAND(F.lit((1 << 33) - 1))  # the number within the partition
    return joined.select(*(qcol(c) for c in df.columns), (F.col("__first") + own).alias(name))
