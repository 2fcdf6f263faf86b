"""From raw documents to token ids: the stages of a training corpus, in order.

Each stage takes all that the one before kept and gives back rows with the
columns of ``documents``; the last gives the ids.  Between stages the rows are
written as Parquet in the shared scratch folder and read again, so a lost
executor costs one stage's share at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.llm import decontaminate, language_id, pii, queries, simhash
from scrubjay.llm.common import bound_batches
from scrubjay.session import Scratch, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; null texts and texts without a letter go.

    Profiles come from the documents that name their language.  Where none
    does, every text with a letter stays.
    """
    bound_batches(spark)
    profiles = language_id.learn_profiles(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language_id.language(F.col("text"), profiles)["lang_pred"] != language_id.UNDETERMINED)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    bound_batches(spark)
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to four fifths."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    text = pii.redact(docs, pii.learn(docs))
    return text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of the ids and of the bytes that they decode to."""
    bound_batches(spark)
    return queries.bpe_digests(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: No stage but the last could be said in SQL in part; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote for itself goes when the stage has been written.

    Each run writes in a folder of its own.  The last stage is lazy, so what it
    reads stays; run within a ``Scratch`` and delete that to be rid of it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
            scratch.clear(keep=docs)
        return STAGES[-1][1](spark, docs, sf_dir)
