"""Ranked lexical search: the k best documents of each item, exactly, without scoring what can't be among them.

One pass over the texts writes an index of the items' terms: for each document
its length and how often it holds each term that the items may have (a bitmap
of fixed size lets few others through).  For each term the index then stores
its document frequency, its weight, its largest impact and its k-th largest
one (rounded down, so a bound too), from sums that are made before anything is
shuffled.

An item's k-th score can't be below the k-th impact of any of its terms.  That
threshold is raised once: the postings of the item's rarest terms are summed,
the k best of those documents are scored exactly, and the least of these scores
is a threshold as well.  An item's terms are then put in the order of what their
postings cost for the impact that they may bring, the cheap ones first; from the
place on where all the rest together stay below the threshold, terms can't bring
a new document among the best, and are pruned.  The postings of the terms before
it are summed; the k-th of these sums is a threshold once more, and only
documents whose sum with the rest's bound still reaches it are rescored by all
terms.

All arithmetic but the weights' logarithm is in whole numbers.  Nothing is cut:
the threshold is a lower bound, and ties are kept.

Defined results: null and empty texts, and those without a term, are no
documents; items without a term rank none.  Equal scores go by ascending id,
rows without an id last.  Repeated rows are documents of their own, and so are
repeated items.  Extra columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
import xxhash

from scrubjay.llm.common import join_hot, materialize

#: Bytes that terms are made of, A-Z lower-cased; all others part them.
_KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MOST_BITS = 26
_BITS_A_TERM = 64
_CACHED = 200_000
#: Stored k-th impacts are rounded down to a multiple of this, a thousandth of a term's largest possible one.
GRAIN = 1000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters, digits and other than ASCII characters."""
    return (text or "").encode().translate(_KEPT).split()


def weight(n_docs: Column | int, df: Column) -> Column:
    """Weight of a term in ``df`` of ``n_docs`` documents."""
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * df + 1)))


def share(tf: Column, length: Column, n_docs: int, all_terms: int) -> Column:
    """What a term's weight is multiplied by: in millionths, by its occurrences and the document's length."""
    whole = lambda a, b: F.call_function("div", a, b)
    m = F.lit(50).cast("long") + whole(F.lit(50).cast("long") * length * F.lit(n_docs), F.lit(all_terms))
    tf = tf.cast("long")
    return whole(F.lit(1_000_000_000).cast("long") * tf, F.lit(1000) * tf + F.lit(20) * m)


# --- index -------------------------------------------------------------------


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term), each term of an item once; ``item`` numbers the rows."""
    own = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["item_id"], T.StructField("terms", T.ArrayType(T.StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[t.decode() for t in dict.fromkeys(terms_of(x.as_py()))] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], schema.names)

    numbered = own.mapInArrow(read, schema).withColumn("item", F.monotonically_increasing_id())
    return numbered.select("item", "item_id", F.explode("terms").alias("term"))


def bitmap(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """Words of 64 bits with a bit for each term's hash, at most ``2 ** 26`` bits, and how many bits that is."""
    terms = wanted.select("term").distinct()
    bits = min(_MOST_BITS, max(10, math.ceil(math.log2(max(1, terms.count()) * _BITS_A_TERM))))

    @F.arrow_udf("long")
    def place(rows: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_intdigest(x.as_py()) >> (64 - bits) for x in rows], pa.int64())

    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    rows = terms.select(place("term").alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words, bits


def doc_terms(docs: DataFrame, doc_id: str, text: str, words: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, n, terms, tfs) of each text with a term: all its terms counted, those listed that the bitmap has."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["doc_id"], *T._parse_datatype_string("n long, terms array<string>, tfs array<int>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        for batch in batches:
            keep, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, value in enumerate(batch.column(1)):
                found = terms_of(value.as_py())
                if not found:
                    continue
                keep.append(i)
                sizes.append(len(found))
                for term, tf in Counter(found).items():
                    held = known.get(term)
                    if held is None:
                        at = xxhash.xxh3_64_intdigest(term) >> (64 - bits)
                        held = bool(int(words[at >> 6]) >> (at & 63) & 1)
                        if len(known) >= _CACHED:
                            known.clear()
                        known[term] = held
                    if held:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], schema.names)

    return own.mapInArrow(read, schema)


@dataclass(frozen=True)
class Index:
    """Documents (row, doc_id, n, terms, tfs), what is stored of each term (term, df, w, most, kth), and the corpus' sizes."""

    docs: DataFrame
    terms: DataFrame
    n_docs: int
    all_terms: int

    def postings(self, docs: DataFrame | None = None) -> DataFrame:
        """(..., term, share) of the documents, or of joined rows of them."""
        docs = self.docs if docs is None else docs
        each = docs.withColumn("x", F.explode(F.arrays_zip("terms", "tfs"))).drop("terms", "tfs")
        return each.withColumns({"term": F.col("x.terms"), "share": share(F.col("x.tfs"), F.col("n"), self.n_docs, self.all_terms)}).drop("x", "n", "doc_id")


def build(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, k: int) -> Index | None:
    """The index of the terms in ``wanted``; None if no document holds a term."""
    held = doc_terms(docs, doc_id, text, *bitmap(wanted)).select(F.monotonically_increasing_id().alias("row"), "*")
    held = materialize(held, "doc_terms")
    n_docs, all_terms = held.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    index = Index(held, held, n_docs, all_terms)
    grains = index.postings().groupBy("term", F.floor(F.col("share") / GRAIN).alias("grain")).agg(F.count("*").alias("n"), F.max("share").alias("most"))
    falling = Window.partitionBy("term").orderBy(F.desc("grain"))  # a thousand rows a term at most
    upto = grains.withColumn("upto", F.sum("n").over(falling))
    kth = F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("grain"))) * GRAIN, F.lit(0))
    stored = upto.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"), kth.alias("kth"))
    stored = stored.join(wanted.select("term").distinct(), "term", "left_semi")  # what the bitmap let through
    w = weight(n_docs, F.col("df"))
    terms = stored.select("term", "df", w.alias("w"), (w * F.col("most")).alias("most"), (w * F.col("kth")).alias("kth"))
    return Index(held, materialize(terms, "terms"), n_docs, all_terms)


# --- search ------------------------------------------------------------------


def _best(pairs: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each item, numbered; Spark cuts each part down to k before it shuffles."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def sums(index: Index, chosen: DataFrame) -> DataFrame:
    """(item, row, part): impacts of some of the items' terms, summed over the documents that hold one."""
    found = join_hot(index.postings(), chosen.select("item", "term", "w"), ["term"], counts=index.terms.select("term", F.col("df").alias("n")))
    return found.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("share")).alias("part"))


def scored(index: Index, pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(item, row, score) of pairs, by all of the item's terms."""
    each = index.postings(index.docs.drop("doc_id").join(pairs.select("item", "row"), "row"))
    return each.join(own.select("item", "term", "w"), ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("share")).alias("score"))


def thresholds(index: Index, own: DataFrame, k: int, first_postings: int) -> DataFrame:
    """(item, least): a lower bound of each item's k-th score."""
    stored = own.groupBy("item").agg(F.max("kth").alias("least"))
    rising = Window.partitionBy("item").orderBy("df", "term")  # one item's terms
    rare = own.withColumn("through", F.sum("df").over(rising)).where(F.col("through") <= first_postings)
    first = _best(sums(index, rare), k, [F.desc("part"), F.col("row")])
    exact = scored(index, materialize(first, "first"), own)
    kth = exact.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    return stored.join(kth, "item", "left").select("item", F.greatest("least", F.coalesce("kth", F.lit(0))).alias("least"))


def candidates(index: Index, own: DataFrame, least: DataFrame, k: int, prunable: float = 0.3) -> DataFrame:
    """(item, row) of all documents that may be among an item's k best.

    Terms are pruned while their bounds add up to less than the threshold's
    ``prunable`` part (1 at most): the more is pruned, the fewer postings are
    summed, and the more documents the rest's bound leaves to rescore.
    """
    cost = F.col("df") / F.greatest("most", F.lit(1))
    falling = Window.partitionBy("item").orderBy(cost.desc(), F.desc("term"))  # from the costly end: sums of suffixes
    bounded = own.join(least, "item").withColumn("rest", F.sum("most").over(falling))
    bounded = materialize(bounded.select("item", "term", "w", "most", "least", (F.col("rest") >= F.col("least") * F.lit(prunable)).alias("needed")), "bounds")
    rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))), F.lit(0))
    # a row for each item, written so that its size is known: an item's documents needn't meet for the joins
    pruned = materialize(bounded.groupBy("item").agg(F.first("least").alias("least"), rest.alias("rest"), (F.sum("most") / GRAIN + 1).cast("long").alias("width")), "pruned")
    found = materialize(sums(index, bounded.where("needed")), "sums")
    # the k-th sum, rounded down: a thousand steps an item
    steps = found.join(pruned, "item").groupBy("item", "width", F.floor(F.col("part") / F.col("width")).alias("step")).agg(F.count("*").alias("n"))
    upto = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("item").orderBy(F.desc("step"))))
    kth = upto.where(F.col("upto") >= k).groupBy("item").agg(F.max(F.col("step") * F.col("width")).alias("kth"))
    bounds = materialize(pruned.join(kth, "item", "left").select("item", "rest", F.greatest("least", F.coalesce("kth", F.lit(0))).alias("least")), "thresholds")
    return found.join(bounds, "item").where(F.col("part") + F.col("rest") >= F.col("least")).select("item", "row")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 50, first_postings: int = 5000) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's k best documents.

    ``first_postings`` bounds the postings that raise an item's threshold; it
    changes what is pruned, never what is found.
    """
    wanted = materialize(item_terms(items, item_id, item_text), "item_terms")
    index = build(docs, wanted, doc_id, text, k)
    if index is None:
        own = docs.select(F.col(doc_id).alias("doc_id"))
        return items.select(F.col(item_id).alias("item_id")).limit(0).join(own, F.lit(False)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    own = materialize(join_hot(wanted.select("item", "term"), index.terms, ["term"]), "own_terms")
    pairs = materialize(candidates(index, own, thresholds(index, own, k, first_postings), k), "candidates")
    ids = index.docs.select("row", "doc_id")
    found = scored(index, pairs, own).where("score > 0").join(ids, "row")
    best = _best(found, k, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")])
    names = wanted.select("item", "item_id").distinct()
    return best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
