"""Language identification by rank-order n-gram profiles.

Every language has a profile: its ``profile_size`` most frequent letter
n-grams (one to three letters, a word's edge counted as a character), most
frequent first, ties by code point.  A text has such a list too.  The
out-of-place distance adds, over the text's n-grams, how far each one's rank
is from its rank in the profile (``profile_size`` if it isn't there); the
nearest profile names the language, ties by name.

Defined results: a text that is null or has no letter gives ``und`` with score
0.0; so does every text if there is nothing to learn from.  The score is
1 - distance / largest possible distance.  Rows are judged one by one, so
repeated rows get equal results and extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDETERMINED = "und"
#: An edge of a word; a control character, so no letter has this code.
_EDGE = 1
_BITS = 21
#: Codes gathered before they are counted, which bounds a task's memory.
_CHUNK = 2_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """Code of every n-gram of the text, in no order, with repeats."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letters = np.concatenate(([False], _letters()[points], [False]))
    if not letters.any():
        return np.empty(0, np.int64)
    line = np.full(len(letters), _EDGE, np.int64)
    line[1:-1][letters[1:-1]] = points[letters[1:-1]]
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first edge after a word
    keep[0] = True
    line = line[keep]
    if line[1] == _EDGE:
        line = line[1:]
    pairs = (line[:-1] << _BITS) | line[1:]
    triples = ((line[:-2] << 2 * _BITS) | pairs[1:])[line[1:-1] != _EDGE]
    return np.concatenate((line[line != _EDGE], pairs, triples))


def _top(codes: np.ndarray, size: int) -> np.ndarray:
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(codes, return_inverse=True)
    return values, np.bincount(where, counts, len(values)).astype(np.int64)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, code, n), summed within the partition as far as memory allows."""
    waiting: dict[str, list[np.ndarray]] = {}
    held: dict[str, int] = {}
    summed: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def fold(lang: str) -> None:
        values, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        held[lang] = 0
        if lang in summed:
            old = summed[lang]
            values, counts = _merged(np.concatenate((old[0], values)), np.concatenate((old[1], counts)))
        summed[lang] = values, counts

    def out(lang: str) -> pa.RecordBatch:
        values, counts = summed.pop(lang)
        return pa.record_batch({"lang": pa.array([lang] * len(values), pa.string()), "code": values, "n": counts.astype(np.int64)})

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = ngram_codes(text)
            if not len(codes):
                continue
            waiting.setdefault(lang, []).append(codes)
            held[lang] = held.get(lang, 0) + len(codes)
            if sum(held.values()) > _CHUNK:
                for x in list(waiting):
                    fold(x)
                for x in [x for x in summed if len(summed[x][0]) > _CHUNK]:
                    yield out(x)
    for lang in list(waiting):
        fold(lang)
    for lang in list(summed):
        yield out(lang)


def learn_profiles(rows: DataFrame, text: str = "text", lang: str = "lang", profile_size: int = 300, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Profiles of all languages named in ``rows``; null texts and languages teach nothing.

    n-grams are counted over every row; what reaches the driver is
    ``profile_size`` codes a language, and more than ``max_languages``
    languages raise an error, so the model's size is bounded.
    """
    counted = (
        rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(_count_partition, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "code", "rank").limit(max_languages * profile_size + 1).collect():
        found.setdefault(row.lang, []).append((row.rank, row.code))
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {k: np.array([code for _, code in sorted(found[k])], np.int64) for k in sorted(found)}


def language(text: Column, profiles: dict[str, np.ndarray], profile_size: int = 300) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.empty(0, np.int64)
    ranks = np.full((len(names), len(known) + 1), profile_size * 2, np.int64)  # the last column: in no profile
    for row, name in enumerate(names):
        ranks[row, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))
    absent = ranks == profile_size * 2

    def one(value: str | None) -> tuple[str, float]:
        codes = ngram_codes(value) if value else ()
        if not len(codes) or not names:
            return UNDETERMINED, 0.0
        top = _top(codes, profile_size)
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        far = np.abs(ranks[:, at] - np.arange(len(top)))
        far[absent[:, at]] = profile_size
        total = np.minimum(far, profile_size).sum(1)
        best = int(total.argmin())
        return names[best], 1.0 - float(total[best]) / (profile_size * len(top))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        found = [one(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return judge(text)
