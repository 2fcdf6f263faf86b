"""CSV: what kind of file it is, how it is written, and the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubjay.functions.columns import qcol, with_row_id
from scrubjay.session import ROW_ID, materialize
from scrubjay.sources import csv_lines

DELIMITERS = (",", ";", "\t", "|")
SAMPLE_BYTES, SAMPLE_LINES = 256 * 1024, 50


def kind_of(head: bytes, extension: str) -> str:
    """xlsx, xls or csv by a file's first bytes; raises if the name says otherwise or the file isn't text."""
    if head.startswith(b"PK\x03\x04"):
        found = "xlsx"
    elif head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        found = "xls"
    elif b"\0" in head[:8192] and not head.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise ValueError("a binary file")
    else:
        found = "csv"
    named = extension.lower().lstrip(".")
    if {"txt": "csv", "tsv": "csv"}.get(named, named) != found:
        raise ValueError(f"named .{named}, but it is {found}")
    return found


def encoding_of(head: bytes) -> str:
    """UTF-8 if the bytes are, else what their marks and contents suggest."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 3:  # cut within a character
            return "utf-8"
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(head).best()
        return best.encoding.replace("_", "-") if best else "windows-1252"
    except ImportError:
        return "windows-1252"


def delimiter_of(lines: Iterable[str]) -> str:
    """The delimiter that occurs most evenly, then most often; a comma if none does."""
    lines = [x for x in lines if x.strip()][:SAMPLE_LINES]
    best, best_score = ",", (False, 0, 0)
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines if d in x]
        score = (bool(counts) and len(set(counts)) <= 2, sum(counts), len(counts))
        if counts and score > best_score:
            best, best_score = d, score
    return best


def head_of(spark: SparkSession, path: str, n: int = SAMPLE_BYTES) -> bytes:
    """A file's first bytes, from any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def detect(spark: SparkSession, path: str) -> dict:
    """Encoding and delimiter from a file's first bytes."""
    head = head_of(spark, path)
    encoding = encoding_of(head)
    return {"encoding": encoding, "delimiter": delimiter_of(head.decode(encoding, "replace").splitlines())}


def _names(header: list[str | None]) -> list[str]:
    """Names for a header: blanks by number, repeats by count."""
    out, seen = [], {}
    for i, name in enumerate(header):
        name = str(name).strip() if name is not None and str(name).strip() else f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def frame_of(spark: SparkSession, rows: list[list]) -> DataFrame:
    """A frame from a header and rows, as a workbook's sheet gives them: trailing empty rows go, short rows are filled."""
    while rows and all(x is None or x == "" for x in rows[-1]):
        rows = rows[:-1]
    if not rows:
        raise ValueError("an empty sheet")
    width = max(map(len, rows))
    names = _names([*rows[0], *[None] * (width - len(rows[0]))])
    body = [tuple([*r, *[None] * (width - len(r))]) for r in rows[1:]]
    kinds = []
    for i in range(width):
        found = {type(r[i]) for r in body if r[i] is not None}
        kinds.append(T.LongType() if found == {int} else T.DoubleType() if found and found <= {int, float} else T.BooleanType() if found == {bool} else T.StringType())
    cast = lambda v, k: v if v is None else float(v) if isinstance(k, T.DoubleType) else str(v) if isinstance(k, T.StringType) else v
    data = [tuple(cast(v, k) for v, k in zip(r, kinds, strict=True)) for r in body]
    return sanitized(spark.createDataFrame(data, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])))


def sanitized(df: DataFrame) -> DataFrame:
    """NaN as null, and row ids."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df = df.select(*(F.nanvl(qcol(c), F.lit(None).cast("double")).alias(c) if c in floats else qcol(c) for c in df.columns))
    return df if ROW_ID in df.columns else with_row_id(df, ROW_ID)


def _in_file_order(df: DataFrame) -> DataFrame:
    """A scan of files with dense row ids in the order of the files' names and their lines."""
    place = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")}
    rows = df.select("*", *(c.alias(n) for n, c in place.items()), F.monotonically_increasing_id().alias("__at"))
    spans = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # a row for each range of bytes
    earlier = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("__file", "__block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    offsets = materialize(offsets, "ranges")  # so that its size is known to the join
    numbered = rows.join(offsets, ["__file", "__block"])
    return numbered.select(*map(qcol, df.columns), (F.col("__at") + F.col("__shift")).alias(ROW_ID))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, schema: T.StructType | None = None, most_rows: int | None = None) -> DataFrame:
    """A CSV file (or a folder of them) with header as a frame with row ids; ``most_rows`` rejects larger files, it never cuts.

    A pass over the lines tells whether a quoted field runs over a line's end.
    Where none does, Spark's reader takes the file in ranges; else records are
    put together from lines, in ranges as well.  Only encodings of several
    bytes a character for all (UTF-16, UTF-32) are read by one task a file.
    """
    found = detect(spark, path) if encoding is None or delimiter is None else {}
    encoding, delimiter = encoding or found["encoding"], delimiter or found["delimiter"]
    options = {"sep": delimiter, "escape": '"'}
    reader = spark.read.options(**options, header=True, encoding=encoding)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if not csv_lines.by_byte(encoding):
        df = reader.option("multiLine", True).csv(path)
    else:
        lines = csv_lines.lines_of(spark, path, encoding)
        quotes = csv_lines.quotes_of(lines, delimiter)
        if quotes.any:
            df = csv_lines.read(spark, csv_lines.records(lines, delimiter, quotes), options, schema, ROW_ID)
        else:
            df = _in_file_order(reader.csv(path))
    if most_rows is not None and df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return sanitized(df)
