"""CSV records whose quoted fields run over lines, read by many tasks.

Spark deals a file out in ranges of bytes, each with the lines that begin in
it; a range is cut into pieces of a fixed number of lines, so that no task holds
a range.  Whether a line begins within quotes isn't known there, but what it
does is: begun outside it ends outside or inside, and begun inside likewise.
Such steps compose, so each piece says in one row what it does to either
beginning; a window over those rows gives each piece its own beginning, and
every line its state.  A record begins at a line that begins outside.  Records
of one line are ready; the lines of others, also those in other pieces, are
gathered by the record's number.

A quote opens a field only at the field's beginning, and closes it unless a
second one follows, as Spark's own reader has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubjay.session import materialize

QUOTE = '"'
#: Lines of a piece at most, a power of two, and lines that a task is dealt on average.
PIECE_LINES, TASK_LINES = 1 << 15, 1 << 17
PIECE = ("file", "block", "piece")
#: Encodings in which a line feed is one byte that is part of no other character.
BY_BYTE = ("utf-8", "us-ascii", "ascii", "iso-8859", "latin", "windows-12", "cp12")


def by_byte(encoding: str) -> bool:
    """Whether a file in this encoding may be cut at line feeds before it is decoded."""
    return encoding.lower().replace("_", "-").startswith(BY_BYTE)


def lines_of(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, at, piece, line): each line, where its range begins, its number within what a task reads, and its piece."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), line.alias("line"))
    return lines.withColumn("piece", F.shiftright("at", PIECE_LINES.bit_length() - 1))


def ends_inside(line: Column, delimiter: str, inside: bool) -> Column:
    """1 if a line that begins inside (or outside) of quotes ends inside, else 0."""
    parts = F.split(line, QUOTE, -1)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)  # what stands before each quote
    if not inside:  # a line's beginning is a field's
        before = F.transform(before, lambda p, i: F.when(i == 0, F.concat(F.lit(delimiter), p)).otherwise(p))
    opens = lambda p: p.endswith(delimiter)
    # 0 outside, 1 inside, 2 behind a quote that closes unless another follows
    step = lambda state, p: F.when(state == 1, F.lit(2)).when((state == 2) & (p == ""), F.lit(1)).when(opens(p), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.aggregate(before, F.lit(int(inside)), step) == 1, 1).otherwise(0)


def stepped(lines: DataFrame, delimiter: str) -> DataFrame:
    """``lines`` with what each does to the state: ``sets`` it to 0 or 1 (null if it doesn't), or ``swaps`` it (0 or 1)."""
    quoted = F.contains("line", F.lit(QUOTE))
    out = F.when(quoted, ends_inside(F.col("line"), delimiter, False)).otherwise(0)
    into = F.when(quoted, ends_inside(F.col("line"), delimiter, True)).otherwise(1)
    marked = lines.withColumns({"__out": out, "__in": into})
    return marked.withColumns({"sets": F.when(F.col("__out") == F.col("__in"), F.col("__out")), "swaps": F.when(F.col("__out") > F.col("__in"), 1).otherwise(0)}).drop("__out", "__in")


def _composed(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``steps`` with ``known`` and ``turned``: the state behind each is the sum of both, modulo 2; ``known`` is null where only the beginning tells."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turned = steps.withColumn("turned", F.sum("swaps").over(upto))
    return turned.withColumn("known", F.last(F.when(F.col("sets").isNotNull(), F.pmod(F.col("sets") + F.col("turned"), F.lit(2))), ignorenulls=True).over(upto))


def _state(known: Column, turned: Column, start: Column) -> Column:
    return F.pmod(F.coalesce(known, start) + F.coalesce(turned, F.lit(0)), F.lit(2))


@dataclass(frozen=True)
class Quotes:
    """The pieces of files, what changes the state in them, and how many tasks they are dealt to; no steps if no quoted field runs over a line's end."""

    pieces: DataFrame
    steps: DataFrame | None
    tasks: int

    @property
    def any(self) -> bool:
        return self.steps is not None


def quotes_of(lines: DataFrame, delimiter: str) -> Quotes:
    """A pass that counts the lines, and one over them if there are quotes; only those that change the state are shuffled.

    Lines are dealt to a number of tasks that goes by their own: sizes of
    shuffles say little, as lines and their files' names compress well.
    """
    pieces = materialize(lines.groupBy(*PIECE).agg(F.count("*").alias("lines"), F.max(F.contains("line", F.lit(QUOTE))).alias("quoted")), "pieces")
    n, quoted = pieces.agg(F.coalesce(F.sum("lines"), F.lit(0)), F.max("quoted")).first()
    tasks = 1 + n // TASK_LINES
    if not quoted:
        return Quotes(pieces, None, tasks)
    steps = stepped(lines, delimiter).where(F.col("sets").isNotNull() | (F.col("swaps") > 0)).drop("line").repartition(tasks, *PIECE)
    last = _composed(steps, [*PIECE], ["at"]).groupBy(*PIECE).agg(F.max_by("known", "at").alias("sets"), F.sum("swaps").alias("swaps"), F.max(F.coalesce("sets", "swaps")).alias("opens"))
    found = materialize(last, "quoted_pieces")
    return Quotes(pieces, None if found.where("opens = 1").isEmpty() else found, tasks)


def records(lines: DataFrame, delimiter: str, quotes: Quotes) -> DataFrame:
    """(file, number, record): the records of each file in order, headers first, blank lines between them left out."""
    steps = quotes.pieces.join(quotes.steps, [*PIECE], "left")
    # what a piece sets is already turned by its own swaps
    steps = steps.select(*PIECE, F.pmod(F.col("sets") + F.col("swaps"), F.lit(2)).alias("sets"), F.when(F.col("sets").isNull(), F.pmod(F.coalesce("swaps", F.lit(0)), F.lit(2))).otherwise(0).alias("swaps"))
    along = Window.partitionBy("file").orderBy("block", "piece")  # a row for each piece of a file
    ends = _composed(steps, ["file"], ["block", "piece"]).withColumn("end", _state(F.col("known"), F.col("turned"), F.lit(0)))
    starts = ends.select(*PIECE, F.coalesce(F.lag("end").over(along), F.lit(0)).alias("start"))
    own = Window.partitionBy(*PIECE).orderBy("at")  # the lines of one piece
    dealt = stepped(lines, delimiter).repartition(quotes.tasks, *PIECE)
    held = _composed(dealt, [*PIECE], ["at"]).join(F.broadcast(starts), [*PIECE])
    held = held.withColumns({"inside": _state(F.lag("known").over(own), F.lag("turned").over(own), F.col("start")), "goes_on": _state(F.col("known"), F.col("turned"), F.col("start"))})
    begins = F.when((F.col("inside") == 0) & ((F.col("goes_on") == 1) | (F.trim(F.regexp_replace("line", "\r$", "")) != "")), 1).otherwise(0)
    held = held.withColumn("nth", F.sum(begins).over(own.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("inside") == 1) | (begins == 1))
    held = materialize(held.select(*PIECE, "at", "line", "inside", "goes_on", "nth"), "lines")
    counts = held.groupBy(*PIECE).agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select(*PIECE, before.alias("before")), "counts")
    numbered = held.join(F.broadcast(counts), [*PIECE]).withColumn("number", F.col("before") + F.col("nth") - 1)
    whole = (F.col("inside") == 0) & (F.col("goes_on") == 0)
    single = numbered.where(whole).select("file", "number", F.col("line").alias("record"))
    parts = numbered.where(~whole).repartition(quotes.tasks, "file", "number").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))  # one record's lines
    joined = parts.select("file", "number", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    return single.union(joined)


def read(spark: SparkSession, found: DataFrame, options: dict, schema, row_id: str) -> DataFrame:
    """The records as a frame with row ids in the order of the files and their records."""
    options = options | {"multiLine": True}
    # a row for each file, written so that its size is known to the joins; lines that end in \r\n have that as their break in quotes too
    sizes = found.groupBy("file").agg(F.max("number").alias("n"), F.max(F.when(F.col("number") == 0, F.endswith("record", F.lit("\r")))).alias("returns"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(sizes.select("file", "returns", earlier.alias("earlier")), "files")
    text = F.regexp_replace("record", "\r$", "")
    found = found.join(files, "file").withColumn("record", F.when(F.col("returns"), F.regexp_replace(text, "\r\n", "\n")).otherwise(text))
    headers = found.where("number = 0").withColumn("record", F.regexp_replace("record", "^\ufeff", ""))
    if schema is None:
        first = headers.orderBy("file").limit(1).select("record")
        texts = getattr(first.coalesce(1).union(found.where("number > 0").select("record"))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark.read.options(**options, header=True, inferSchema=True)._jreader.csv(texts), spark).schema
    rows = found.where("number > 0")
    parsed = rows.select(F.from_csv("record", _ddl(schema), {k: str(v) for k, v in options.items()}).alias("r"), (F.col("earlier") + F.col("number") - 1).alias(row_id))
    return parsed.select("r.*", row_id)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
