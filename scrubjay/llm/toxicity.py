"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (lower-cased words between spaces and ASCII
punctuation, and the first letters of long words, so that a word's forms and
compounds count together), hashed to ``2**24`` numbers.  From a bounded sample
of labelled rows (``most_rows``, drawn by a hash of the id) two kinds of terms
are chosen: those that tell the labels apart by themselves, by a likelihood
ratio test, which takes terms of one label only too; and the most frequent
ones, which may tell only in company.  The machine learns a weight for each and
a vector for each, whose dot products weigh pairs: an insult together with a
mention of a group may count for more than the two alone.

What the driver gets is bounded: ``most_rows`` rows with the chosen terms that
they have, ``most_terms`` and ``frequent_terms`` of the kinds.  Terms are counted by Spark over all
rows of the sample, whatever their length.

Defined results: null and empty texts score what a text without any chosen
term scores; without rows of both labels, all texts score the share of label 1
(0 if there are no rows).  Labels that are null teach nothing; of several
labels of one id the largest counts, of several texts of one id the one with
the smallest hash.  Rows are scored one by one, so repeated rows are equal and
extra columns never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import materialize

_BITS = 24
#: Letters of a word's beginning that count as a term of their own.
PREFIXES = (4, 6)
_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _hash(word: bytes) -> int:
    return zlib.crc32(word) >> (32 - _BITS)


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text."""
    return set((text or "").lower().encode().translate(_GAPS).decode().split())


def hashes_of(word: str) -> list[int]:
    """The word's term and those of its beginnings."""
    return [_hash(word.encode()), *(_hash(f"{word[:n]}~".encode()) for n in PREFIXES if len(word) > n)]


def terms_of(text: str | None) -> list[int]:
    """Hashes of the distinct terms of a text."""
    return sorted({h for w in words_of(text) for h in hashes_of(w)})


@dataclass
class Machine:
    """Bias, weight and vector of each chosen term (hash -> row); words met before are remembered, ``most_words`` of them."""

    rows: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    most_words: int = 200_000

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def _rows_of(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= self.most_words:
            self.known.clear()
        found = tuple(r for h in hashes_of(word) if (r := self.rows.get(h)) is not None)
        if len(word) <= 40:
            self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        get, found = self.known.get, set()
        for word in words_of(text):
            rows = get(word)
            found.update(self._rows_of(word) if rows is None else rows)
        found = sorted(found)
        margin = self.bias
        if found:
            v = self.vectors[found]
            margin += self.weights[found].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def telling(hits: np.ndarray, seen: np.ndarray, n1: float, n: float) -> np.ndarray:
    """Likelihood ratio (G squared) of terms that ``hits`` of ``n1`` rows of label 1 have, and ``seen`` of all ``n`` rows."""
    share = seen / n

    def side(k: np.ndarray, m: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / m / share), 0) + np.where(k < m, (m - k) * np.log((m - k) / m / (1 - share)), 0)

    return 2 * (side(hits, n1) + side(seen - hits, n - n1))


def log_odds(hits: np.ndarray, seen: np.ndarray, n1: float, n: float) -> np.ndarray:
    a, b = hits + 0.5, seen - hits + 0.5
    return np.log(a * (n - n1 - seen + hits + 0.5) / (b * (n1 - hits + 0.5)))


def _adder(at: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of rows by number."""
    return lambda values: np.stack([np.bincount(at, column, n) for column in values.T], 1)


def fit(texts: list[np.ndarray], labels: np.ndarray, odds: dict[int, float], factors: int = 8, steps: int = 300, batch: int = 256, rate: float = 0.1, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Learn by mini-batches with Adagrad steps on the log loss; ``odds`` are the chosen terms with the weights to begin at."""
    share = float((labels.sum()) / max(1, len(labels)))
    if not 0 < share < 1:
        return Machine({}, 40.0 if share else -40.0, np.zeros(0), np.zeros((0, factors)))
    chosen = sorted(odds)
    rows = {h: i for i, h in enumerate(chosen)}
    inputs = [np.array([r for h in t.tolist() if (r := rows.get(h)) is not None], np.int64) for t in texts]
    rng = np.random.default_rng(seed)
    n = len(chosen)
    # weights begin at the terms' own log odds, so that one telling term is enough alone
    w, v, bias = np.array([odds[h] for h in chosen], float), rng.normal(0, 0.01, (n, factors)), float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(n, 1e-8), np.full((n, factors), 1e-8), 1e-8
    for _ in range(-(-steps * batch // len(labels))):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            flat = np.concatenate([inputs[j] for j in own])
            row = np.repeat(np.arange(len(own)), [len(inputs[j]) for j in own])
            by_row, by_term = _adder(row, len(own)), _adder(flat, n)
            sums = by_row(v[flat])
            squares = np.bincount(row, (v[flat] ** 2).sum(1), len(own))
            margin = bias + np.bincount(row, w[flat], len(own)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[own]) / len(own)
            db = error.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            dw = np.bincount(flat, error[row], n) + decay * w / len(own)
            dv = by_term(error[row, None] * (sums[row] - v[flat])) + decay * v / len(own)
            gw += dw * dw
            gv += dv * dv
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine(rows, bias, w, v)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000, most_terms: int = 4096, frequent_terms: int = 1024, least_g2: float = 15.0, **options) -> Machine:
    """A machine from the labelled documents; ``most_rows`` bounds what the driver holds."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array((terms_of(x.as_py()) for x in texts), pa.list_(pa.int32()))

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")  # most_rows rows
    one = own.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = materialize(one.select("doc_id", "label", hashed("text").alias("terms")), "terms")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    counts = materialize(rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("seen"), F.sum("label").alias("hits")), "term_counts")

    @F.arrow_udf("double")
    def tells(hits: pa.Array, seen: pa.Array) -> pa.Array:
        return pa.array(telling(hits.to_numpy(), seen.to_numpy(), n1, n))

    by_themselves = counts.withColumn("g2", tells("hits", "seen")).where(F.col("g2") >= least_g2).orderBy(F.desc("g2"), "term").limit(most_terms)
    frequent = counts.where(F.col("seen") < n).orderBy(F.desc("seen"), "term").limit(frequent_terms)
    chosen = {r.term: (r.hits, r.seen) for part in (by_themselves, frequent) for r in part.collect()} if 0 < n1 < n else {}
    start = {h: float(log_odds(np.float64(a), np.float64(b), n1, n)) if telling(np.array([a]), np.array([b]), n1, n)[0] >= least_g2 else 0.0 for h, (a, b) in chosen.items()}
    kept = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in start], "term int"))  # most_terms + frequent_terms rows
    few = rows.select("doc_id", "label", F.explode("terms").alias("term")).join(kept, "term").groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    held = rows.select("doc_id", "label").join(few, "doc_id", "left").orderBy("doc_id").collect()
    return fit([np.array(sorted(r.terms or ()), np.int64) for r in held], np.array([r.label for r in held]), start, **options)


def score(text: Column, machine: Machine) -> Column:
    """Score (double, 0 to 1) of a text column."""

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array((machine.score(x.as_py()) for x in texts), pa.float64())

    return judge(text)
