"""Statistics that stay exact and distributed: order statistics, modes, moments, histograms.

Nothing here gathers a column or a group in one place.  Order statistics are
found by narrowing, all ranks together: approximate percentiles, whose error is
bounded, give a range around each rank, counts tell where the rank lies in it,
and only ranges of few values are brought to the driver.  A round of two passes
leaves at most a 1600th of the rows, so their number goes by the logarithm of
the rows, and not by the number of ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubjay.functions import ordering
from scrubjay.functions.columns import qcol
from scrubjay.session import materialize

#: Distinct values that an order statistic may bring to the driver at most.
FEW = 20_000


#: Accuracy of the percentiles that narrow a range: a rank is missed by at most a 10,000th of the rows.
ACCURACY = 10_000


@dataclass
class _Range:
    """Where the value at a rank lies: strictly between two values (None for no bound), with so many rows before and within."""

    rank: int
    low: object
    high: object
    before: int
    rows: int

    def test(self, v: Column) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (v > self.low)
        return inside if self.high is None else inside & (v < self.high)

    def holds(self, v) -> bool:
        return (self.low is None or v > self.low) and (self.high is None or v < self.high)

    def near(self) -> list[float]:
        q = (self.rank - self.before + 0.5) / self.rows
        return [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)]

    def narrowed(self, low, high, counts: Sequence[int]) -> tuple[_Range | None, object]:
        """The part that the rank is in, or the value if that is found; counts are below, at and between low and high, and at high."""
        at = self.before
        for value, part, n in zip((None, low, None, high, None), ((self.low, low), None, (low, high), None, (high, self.high)), (*counts, self.rows - sum(counts)), strict=True):
            if self.rank < at + n:
                return (None, value) if part is None else (_Range(self.rank, *part, at, n), None)
            at += n
        return None, None


def at_rank(values: DataFrame, column: str, rank: int, few: int = FEW):
    """The value at a 0-based rank of a numeric column without nulls, exactly."""
    return at_ranks(values, column, [rank], few)[0]


def around_quantiles(column: str, qs: Sequence[float]) -> Column:
    """Aggregate: values a little below and a little above each quantile, for at_ranks."""
    return F.percentile_approx(qcol(column), F.array(*(F.lit(x) for q in qs for x in (max(0.0, q - 2.5 / ACCURACY), min(1.0, q + 2.5 / ACCURACY)))), ACCURACY)


def at_ranks(values: DataFrame, column: str, ranks: Sequence[int], few: int = FEW, n: int | None = None, around: Sequence | None = None) -> list:
    """The values at several 0-based ranks, None beyond the last, found together.

    Each round narrows all ranges by one pass for percentiles and one for
    counts; one more pass brings what is left.  Who has counted the values, and
    their ``around_quantiles`` at the ranks, saves two passes.
    """
    c = qcol(column)
    rows, v = values.where(c.isNotNull()).select(c.alias("v")), F.col("v")
    n = rows.count() if n is None else n
    out: list = [None] * len(ranks)
    wanted = {i: _Range(r, None, None, 0, n) for i, r in enumerate(ranks) if 0 <= r < n}
    while any(x.rows > few for x in wanted.values()):
        wide = [i for i, x in wanted.items() if x.rows > few]
        if around:
            found = [tuple(around[2 * i : 2 * i + 2]) for i in wide]
        else:
            near = [F.percentile_approx(F.when(wanted[i].test(v), v), F.array(*map(F.lit, wanted[i].near())), ACCURACY) for i in wide]
            found = rows.agg(*(x.alias(f"p{k}") for k, x in enumerate(near))).first()
        around = None
        aggs = []
        for i, (low, high) in zip(wide, found, strict=True):
            inside = wanted[i].test(v)
            aggs += [F.count_if(inside & (v < low)), F.count_if(inside & (v == low)), F.count_if((v > low) & (v < high)), F.count_if((v == high) & (high > low))]
        counts = rows.agg(*(x.alias(f"n{k}") for k, x in enumerate(aggs))).first()
        for k, (i, (low, high)) in enumerate(zip(wide, found, strict=True)):
            left, out[i] = wanted[i].narrowed(low, high, counts[4 * k : 4 * k + 4])
            if left is None:
                del wanted[i]
            else:
                wanted[i] = left
    if wanted:
        inside = reduce(operator.or_, (x.test(v) for x in wanted.values()))
        held = sorted((r.v, r.n) for r in rows.where(inside).groupBy("v").agg(F.count("*").alias("n")).collect())
        for i, x in wanted.items():
            seen = x.before
            for value, count in held:
                if x.holds(value):
                    seen += count
                    if x.rank < seen:
                        out[i] = value
                        break
    return out


def quantiles_nearest(values: DataFrame, column: str, qs: Sequence[float]) -> list:
    """The values at the nearest ranks to some quantiles, no interpolation; None if there are none."""
    n = values.where(qcol(column).isNotNull()).count()
    return at_ranks(values, column, [_half_up((n - 1) * q) for q in qs]) if n else [None] * len(qs)


def quantile_nearest(values: DataFrame, column: str, q: float):
    return quantiles_nearest(values, column, [q])[0]


def _half_up(x: float) -> int:
    return int(x + 0.5)


def median(values: DataFrame, column: str) -> float | None:
    """The middle value, or the mean of the two in the middle."""
    n = values.where(qcol(column).isNotNull()).count()
    if not n:
        return None
    low, high = at_ranks(values, column, [(n - 1) // 2, n // 2])
    return (float(low) + float(high)) / 2


def mode_smallest(values: DataFrame, column: str):
    """The most frequent value that isn't null, the smallest on ties; None if there is none."""
    counts = values.where(qcol(column).isNotNull()).groupBy(qcol(column).alias("v")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "v").limit(1).collect()
    return best[0].v if best else None


def group_mode(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Keys and each group's most frequent value, the smallest on ties."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(qcol(k).alias(n) for k, n in zip(keys, names, strict=True)), qcol(column).alias("v"))
    counts = rows.where(F.col("v").isNotNull()).groupBy(*names, "v").agg(F.count("*").alias("n"))
    best = counts.groupBy(*names).agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias(out))
    return best.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), out)


def group_ranks(df: DataFrame, keys: Sequence[str], value: Column, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> DataFrame:
    """Per group and distinct value: how many rows have it (n), how many a value up to it (upto), rows in all (total).

    Rows are summed by value first.  If those sums fit one bucket, so does each
    group, and is sorted by itself.  Else all sums are dealt to buckets in the
    order of group and value, so that a group of any size is spread over as
    many tasks as it needs; ranks are then counted from the group's start.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(qcol(k).alias(x) for k, x in zip(keys, names, strict=True)), value.alias("v")).where(F.col("v").isNotNull())
    counts = materialize(rows.groupBy(*names, "v").agg(F.count("*").alias("n")), "value_counts")
    ordered = ordering.by_key(counts, F.struct(*names, "v"), rows_per_bucket)
    upto = Window.unboundedPreceding, 0
    if ordered.buckets == 1:
        group = Window.partitionBy(*names)
        ranked = counts.withColumns({"upto": F.sum("n").over(group.orderBy("v").rowsBetween(*upto)), "total": F.sum("n").over(group)})
    else:
        frame = ordering.handed_on(ordered, F.sum("n"), "__before")
        placed = frame.withColumn("through", F.col("__before") + F.sum("n").over(ordered.window().rowsBetween(*upto)))
        groups = placed.groupBy(*names).agg(F.min(F.col("through") - F.col("n")).alias("start"), F.sum("n").alias("total"))
        groups = groups.select(*(F.col(x).alias(x + "g") for x in names), "start", "total")
        same = reduce(operator.and_, (F.col(x).eqNullSafe(F.col(x + "g")) for x in names))
        ranked = placed.join(groups, same).withColumn("upto", F.col("through") - F.col("start"))
    return ranked.select(*(F.col(x).alias(k) for k, x in zip(keys, names, strict=True)), "v", "n", "upto", "total")


def _pick(rank: Column) -> Column:
    """Aggregate over group_ranks: the value at a 0-based rank."""
    return F.min(F.when(F.col("upto") > rank, F.col("v")))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: Column, rows_per_bucket: int = ordering.ROWS_PER_BUCKET) -> DataFrame:
    """Per group: n, median (interpolated), q1 and q3 (nearest rank) of a numeric column."""
    ranks = group_ranks(df, keys, value, rows_per_bucket)
    total = F.col("total")
    near = lambda q: _pick(F.floor((total - 1) * q + 0.5))
    return ranks.groupBy(*(qcol(k) for k in keys)).agg(
        F.max("total").alias("n"),
        ((_pick(F.floor((total - 1) / 2)) + _pick(F.floor(total / 2))) / 2).alias("median"),
        near(0.25).alias("q1"),
        near(0.75).alias("q3"),
    )


def group_median(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    ranks = group_ranks(df, keys, value)
    total = F.col("total")
    return ranks.groupBy(*(qcol(k) for k in keys)).agg(((_pick(F.floor((total - 1) / 2)) + _pick(F.floor(total / 2))) / 2).alias(out))


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, n): equal bins from smallest to largest, closed on the right, the first on both sides."""
    c = qcol(column)
    low, high = values.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    spark = values.sparkSession
    schema = "bin int, lower double, upper double, n long"
    if low is None:
        return spark.createDataFrame([], schema)
    width = (high - low) / bins or 1.0 / bins
    number = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((c.cast("double") - low) / width).cast("int")))
    counts = values.where(c.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edges = frame.select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"), (F.lit(low) + F.col("bin") * width).alias("upper"))
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def smallest(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, value) of each key's ``k`` smallest distinct values.

    One minimum a pass, summed before it is shuffled, so a key costs some
    values for each part of the table, however many it has.
    """
    rows, found, last = df.where(qcol(value).isNotNull()), [], None
    for _ in range(k):
        left = rows if last is None else rows.join(last, qcol(key).eqNullSafe(F.col("__key"))).where(qcol(value) > F.col("__last"))
        best = materialize(left.groupBy(qcol(key)).agg(F.min(qcol(value)).alias(value)), "smallest")  # a row for each key, of a known size
        found.append(best)
        last = best.select(qcol(key).alias("__key"), qcol(value).alias("__last"))
    return reduce(DataFrame.union, found)


#: Logarithm of a sketch's size; its estimate is off by 0.8 % as a rule, and next to exact for some thousand values.
SKETCH = 14
#: How far from the truth an estimate is taken to be at most.
SKETCH_ERROR = 0.04


def distinct_sketches(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, n, sketch) of columns by name: how many values there are, and a sketch of the distinct ones.

    One pass without a shuffle of values; sketches of parts of a table, or of
    what is added to it, are put together by ``merged_sketches``.
    """
    aggs = [x for i, c in enumerate(values.values()) for x in (F.count(c).alias(f"n{i}"), F.hll_sketch_agg(c.cast("string"), SKETCH).alias(f"s{i}"))]
    cells = F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, name in enumerate(values)))
    return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketches of several tables as those of all their rows."""
    return reduce(DataFrame.union, sketches).groupBy("name").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> dict[str, tuple[int, int]]:
    """Number of values, and about how many distinct ones, by name."""
    return {r[0]: (r[1], min(r[1], r[2])) for r in sketches.select("name", "n", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))).collect()}


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Exact numbers of distinct values, all columns by one shuffle of (column, value) counts."""
    cells = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), c.cast("string").alias("v"))) for name, c in values.items()))
    each = df.select(F.explode(F.array_compact(cells)).alias("c")).select("c.*").distinct()
    return dict.fromkeys(values, 0) | {r[0]: r[1] for r in each.groupBy("name").count().collect()}
