"""Helpers shared by the corpus operators: shared scratch tables and id hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.session import materialize

__all__ = ["bound_batches", "id_mod", "join_hot", "materialize", "text_or_empty"]


def bound_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Have texts handed to Python in Arrow batches of ``most_bytes`` at most.

    A batch is held several times over (in the JVM, as strings, as results),
    so this bounds a task's memory where texts are long.  A session that asks
    for less keeps its setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= most_bytes:
        spark.conf.set(key, f"{most_bytes}b")


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], salts: int = 64, share: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on keys of which some may be those of very many rows of ``many``; ``counts`` has its rows (n) by key, if known.

    Keys with more than one ``share``-th of the rows, of which there can't be
    more than ``share``, are salted: their rows are dealt out by a hash of
    all their columns, and the rows of ``few`` that have them are copied for
    each salt.
    """
    hot = many.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    total = hot.agg(F.sum("n")).first()[0] or 0
    found = hot.where(F.col("n") > max(total // share, share)).select(*keys).collect()
    if not found:
        return many.join(few, keys)
    id_of = F.xxhash64(*keys)
    marks = [r[0] for r in many.sparkSession.createDataFrame(found, many.select(*keys).schema).select(id_of).distinct().collect()]
    salt = F.when(id_of.isin(marks), F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(id_of.isin(marks), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = few.withColumn("__salt", F.explode(copies))
    return many.withColumn("__salt", salt).join(salted, [*keys, "__salt"]).drop("__salt")


def id_mod(column: Column, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; null for a null id."""
    return F.crc32(column.cast("string")) % F.lit(n)


def text_or_empty(column: Column) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(column, F.lit(""))
