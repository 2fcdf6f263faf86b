"""Whole-table order without one big sort in one task.

Rows are dealt to buckets by bounds on their key, drawn from a hashed sample; a
row's bucket is found by binary search.  Bounds, and what a bucket needs from
others (counts, edge values), are tables with a row per bucket, so plans and
the driver's work don't grow with the data.  A bucket is numbered or filled on
its own, then joined with what the other buckets hand over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubjay.functions.columns import qcol
from scrubjay.session import materialize

ROWS_PER_BUCKET = 1_000_000
_SAMPLE_PER_BUCKET = 64
BUCKET = "__bucket"
POSITION = "__position"


@dataclass(frozen=True)
class Ordered:
    """A frame with a bucket column, and the key that orders rows within and across buckets."""

    frame: DataFrame
    key: Column
    buckets: int

    def window(self):
        return Window.partitionBy(BUCKET).orderBy(self.key)

    def with_frame(self, frame: DataFrame) -> Ordered:
        return Ordered(frame, self.key, self.buckets)


def in_buckets(df: DataFrame, row_id: str, order_by: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> Ordered:
    """Deal rows to buckets in the order of ``[order_by, row_id]`` (nulls first)."""
    key = F.struct(qcol(order_by).alias("o"), qcol(row_id).alias("r")) if order_by else F.struct(qcol(row_id).alias("r"))
    return by_key(df, key, rows_per_bucket)


def by_key(df: DataFrame, key: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> Ordered:
    """Deal rows to buckets of about ``rows_per_bucket`` in the order of a struct that is no two rows' own."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    if buckets == 1:
        return Ordered(df.withColumn(BUCKET, F.lit(0)), key, 1)
    every = max(1, n // (buckets * _SAMPLE_PER_BUCKET))
    drawn = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
    numbered = drawn.select("k", F.row_number().over(Window.orderBy("k")).alias("i"))  # a sample of 64 keys a bucket
    bounds = numbered.where(F.col("i") % _SAMPLE_PER_BUCKET == 0).agg(F.array_sort(F.collect_list("k")).alias("bounds"))
    bounds = materialize(bounds, "bounds")
    frame = df.withColumn(BUCKET, F.lit(0))
    for step in (1 << k for k in reversed(range((2 * buckets + 2).bit_length()))):  # counts the bounds that are no larger than the key
        bound = F.get(bounds.scalar(), F.col(BUCKET) + (step - 1))
        frame = frame.withColumn(BUCKET, F.col(BUCKET) + F.when(bound <= key, step).otherwise(0))
    return Ordered(frame, key, buckets)


def handed_on(ordered: Ordered, amount: Column, name: str) -> DataFrame:
    """The frame with the sum of what all earlier buckets add up to."""
    if ordered.buckets == 1:
        return ordered.frame.withColumn(name, F.lit(0).cast("long"))
    sums = ordered.frame.groupBy(BUCKET).agg(amount.alias("__sum"))
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    return ordered.frame.join(sums.select(BUCKET, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("long").alias(name)), BUCKET)


def with_position(ordered: Ordered, name: str = POSITION) -> DataFrame:
    """Dense 0-based position of each row in the whole order."""
    frame = handed_on(ordered, F.count("*"), "__offset")
    return frame.withColumn(name, F.col("__offset") + F.row_number().over(ordered.window()) - 1).drop("__offset")


def filled(ordered: Ordered, column: str, out: str, forward: bool = True) -> DataFrame:
    """The frame with the last value before (or first after) each row that isn't null, over the whole order."""
    c = qcol(column)
    # backwards as forwards in descending order: a frame that only grows costs one step a row
    order = ordered.key if forward else ordered.key.desc()
    own = F.last(c, ignorenulls=True).over(Window.partitionBy(BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if ordered.buckets == 1:
        return ordered.frame.withColumn(out, own)
    there = F.when(c.isNotNull(), ordered.key)
    ends = ordered.frame.groupBy(BUCKET).agg((F.max_by if forward else F.min_by)(c, there).alias("__end"))
    earlier = Window.orderBy(BUCKET if forward else F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = ends.select(BUCKET, F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    return ordered.frame.join(carried, BUCKET).withColumn(out, F.coalesce(own, F.col("__carried"))).drop("__carried")


def around(df: DataFrame, radius: int, make, order: str = POSITION, block: int = 100_000) -> DataFrame:
    """Columns over a centred window of ``2 * radius + 1`` rows of dense positions.

    ``make`` gets the window and returns named columns.  Rows near a block's
    edge are copied to its neighbour, so blocks are independent.
    """
    p = F.col(order)
    own = F.floor(p / block)
    copies = F.array_distinct(F.array(own, F.floor((p - radius) / block), F.floor((p + radius) / block)))
    dealt = df.withColumn("__block", F.explode(copies)).where(F.col("__block") >= 0)
    w = Window.partitionBy("__block").orderBy(order).rowsBetween(-radius, radius)
    return dealt.withColumns(make(w)).where(F.col("__block") == own).drop("__block")
