"""Date formats: C-style directives as Spark patterns, and parsing of mixed texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are tried, most telling first.
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y", "%Y/%m/%d", "%d %b %Y", "%B %d, %Y")
DATETIME_SUFFIXES = (" %H:%M:%S", " %H:%M", "T%H:%M:%S", "T%H:%M:%S.%f")
TIME_FORMATS = ("%H:%M:%S", "%H.%M.%S", "%H:%M")

_DIRECTIVES = {"%Y": "y", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s", "%f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "%y": "yy", "%p": "a", "%I": "h"}


def spark_pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern; one or two digits are taken for each number."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out += _DIRECTIVES.get(fmt[i : i + 2], fmt[i + 1])
            i += 2
            continue
        out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
        i += 1
    return out


def full_year(c: Column, fmt: str, value: Column) -> Column:
    """A year of four digits where the format has one."""
    return F.when(c.rlike(r"(?<!\d)\d{4}(?!\d)"), value) if "%Y" in fmt else value


def parse_date(c: Column, fmt: str | None = None) -> Column:
    """Date of a text by a format, or by the first of the usual formats that fits; null otherwise."""
    text = c.cast("string")
    formats = [fmt] if fmt else DATE_FORMATS
    return F.coalesce(*(full_year(text, f, F.try_to_timestamp(text, F.lit(spark_pattern(f))).cast("date")) for f in formats))


def parse_datetime(c: Column, fmt: str | None = None) -> Column:
    """Timestamp (without zone) of a text; a date alone counts as midnight."""
    text = c.cast("string")
    formats = [fmt] if fmt else [d + s for d in DATE_FORMATS[:3] for s in DATETIME_SUFFIXES] + list(DATE_FORMATS)
    return F.coalesce(*(full_year(text, f, F.try_to_timestamp(text, F.lit(spark_pattern(f)))) for f in formats)).cast("timestamp_ntz")


def parse_time(c: Column, fmt: str | None = None) -> Column:
    """Time of day of a text as ``HH:mm:ss`` text."""
    text = c.cast("string")
    formats = [fmt] if fmt else TIME_FORMATS
    return F.coalesce(*(F.date_format(F.try_to_timestamp(text, F.lit(spark_pattern(f))), "HH:mm:ss") for f in formats))
