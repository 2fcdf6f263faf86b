"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are token lists (lower-cased runs of letters and
digits).  A seed is a run of ``least`` tokens, known by two rolling Karp-Rabin
hashes (128 bits together).  A document and an item that share seeds are tiled:
again and again the longest run that both share and that no earlier tile covers
is marked, down to ``least`` tokens, ties by place in the document, then in the
item.  The share of the item's tokens that tiles cover is its coverage;
reordered passages count in full, since tiles may come in any order.

How it runs: a bitmap of the benchmark's seeds (``2**27`` bits at most, 16 to a
seed below that) lets the one pass over the documents drop seeds that no item
has; what is left is a table of hits, a small part of the text.  Each item has
anchors: as many neighbouring seeds as must hold one that is shared, if the
coverage is to reach the threshold, and of all such runs the one that is rarest
in the documents.  Hits are joined with the anchors by seed, which gives the
pairs to be tiled; seeds and items that hold a thousandth of the rows or more
are salted.  No text, of documents or benchmark, comes to the driver, and
nothing is handed to executors but the bitmap.

Defined results: null and empty texts, and items of fewer than ``least``
tokens (too little to tell), match nothing.  Rows are judged one by one, so
repeated rows, of documents or items, give repeated results; extra columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import xxhash

from scrubjay.llm.common import join_hot, materialize

_BASES = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = re.compile(r"[\W_]+")
_ASCII_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MOST_BITS, _BITS_A_SEED = 27, 16
_RESULT = "coverage double, matched_tokens long, item_tokens long, n_tiles long, longest_tile long"


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII_GAPS).split()
    return _PUNCTUATION.sub(" ", text).encode().split()


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def rolling(ids: np.ndarray, size: int, base: np.uint64 = _BASES[0], at: np.ndarray | None = None) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every run of ``size`` ids, or of those that begin at some places."""
    n = max(0, len(ids) - size + 1)
    out = np.zeros(n if at is None else len(at), np.uint64)
    for k in range(size):
        out = out * base + (ids[k : k + n] if at is None else ids[at + k]) + np.uint64(1)
    return out


def shared_runs(places: np.ndarray, doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Longest runs (-tokens, place in document, place in item) of shared seeds.

    ``doc`` are the document's seeds at some places in rising order, ``item``
    all seeds of the item in order, as small numbers.  The work is one step for
    each equal pair, what is held one entry for each run.
    """
    by_seed: dict[int, list[int]] = {}
    for i, seed in enumerate(doc.tolist()):
        by_seed.setdefault(seed, []).append(i)
    at = {seed: np.array(x) for seed, x in by_seed.items()}
    next_to = places[1:] == places[:-1] + 1
    follows, precedes = np.append(next_to, False), np.append(False, next_to)
    length, stamp = np.zeros(len(doc) + 1, np.int64), np.full(len(doc) + 1, -1)
    out = []
    for q in range(len(item) - 1, -1, -1):
        own = at.get(int(item[q]))
        if own is None:
            continue
        longer = np.where(follows[own] & (stamp[own + 1] == q + 1), length[own + 1], 0)
        length[own], stamp[own] = longer + 1, q
        begins = ~precedes[own] | (doc[own - 1] != item[q - 1]) if q else np.ones(len(own), bool)
        out += [(1 - least - int(n), int(p), q) for n, p in zip(longer[begins] + 1, places[own[begins]], strict=True)]
    return out


def tiles(runs: list[tuple[int, int, int]], item_tokens: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, length) from the longest shared runs."""
    if not runs:
        return []
    first, last = min(p for _, p, _ in runs), max(p - n for n, p, _ in runs)
    doc_free, item_free, left = bytearray(b"\1") * (last - first), bytearray(b"\1") * item_tokens, item_tokens
    heapq.heapify(runs)
    out = []
    while runs and left >= least:
        size, p, q = heapq.heappop(runs)
        size = -size
        free = [a and b for a, b in zip(doc_free[p - first : p - first + size], item_free[q : q + size], strict=True)]
        if all(free):
            doc_free[p - first : p - first + size] = item_free[q : q + size] = bytes(size)
            left -= size
            out.append((p, q, size))
            continue
        k = 0
        while k < size:  # what is left of this run
            start = k
            while k < size and free[k]:
                k += 1
            if k - start >= least:
                heapq.heappush(runs, (start - k, p + start, q + start))
            k += 1
    return out


def coverage(places: np.ndarray, doc: np.ndarray, item: np.ndarray, item_tokens: int, threshold: float, least: int) -> tuple | None:
    """Coverage and the tiles' figures of one pair, None below the threshold; seeds are (hash, check) rows."""
    number = {seed: i for i, seed in enumerate(dict.fromkeys(map(tuple, item.tolist())))}
    own = np.array([number[x] for x in map(tuple, item.tolist())], np.int64)
    theirs = np.array([number.get(x, -1) for x in map(tuple, doc.tolist())], np.int64)
    shared = theirs >= 0
    seen = np.zeros(item_tokens, bool)
    for q in np.flatnonzero(np.isin(own, theirs[shared])):
        seen[q : q + least] = True
    if seen.sum() < threshold * item_tokens:
        return None  # even all its seeds together cover too little
    found = tiles(shared_runs(places[shared], theirs[shared], own, least), item_tokens, least)
    covered = sum(n for _, _, n in found)
    if covered < threshold * item_tokens:
        return None
    return covered / item_tokens, covered, item_tokens, len(found), max(n for _, _, n in found)


# --- tables ------------------------------------------------------------------


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), kind))


def item_seeds(benchmark: DataFrame, item_id: str, text: str, least: int) -> DataFrame:
    """(item_id, item_tokens, seeds, checks) of each item with a seed, the seeds in their order."""
    own = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["item_id"], *T._parse_datatype_string("item_tokens int, seeds array<long>, checks array<long>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, seeds, checks = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = hashed(tokens_of(text.as_py()))
                if len(ids) >= least:
                    keep.append(i)
                    sizes.append(len(ids))
                    seeds.append(_signed(rolling(ids, least)))
                    checks.append(_signed(rolling(ids, least, _BASES[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int32()), _lists(seeds, pa.int64()), _lists(checks, pa.int64())], schema.names)

    return own.mapInArrow(read, schema)


def bitmap(items: DataFrame) -> tuple[np.ndarray, int]:
    """Bits (in words of 64) that are set for the benchmark's seeds, by the seeds' highest bits; and how many those are."""
    n = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = min(_MOST_BITS, max(10, math.ceil(math.log2(max(1, n) * _BITS_A_SEED))))
    place = F.shiftrightunsigned("seed", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = items.select(F.explode("seeds").alias("seed")).groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words, bits


def doc_hits(docs: DataFrame, doc_id: str, text: str, words: np.ndarray, bits: int, least: int) -> DataFrame:
    """(doc_id, digest, places, seeds, checks) of each text with a seed that the bitmap has; the digest is the text's MD5."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["doc_id"], *T._parse_datatype_string("digest string, places array<int>, seeds array<long>, checks array<long>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, digests, places, seeds, checks = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                ids = hashed(tokens_of(text))
                hashes = rolling(ids, least)
                place = hashes >> np.uint64(64 - bits)
                at = np.flatnonzero((words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                if len(at):
                    keep.append(i)
                    digests.append(hashlib.md5(text.encode()).hexdigest())
                    places.append(at)
                    seeds.append(_signed(hashes[at]))
                    checks.append(_signed(rolling(ids, least, _BASES[1], at)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(digests, pa.string()), _lists(places, pa.int32()), _lists(seeds, pa.int64()), _lists(checks, pa.int64())], schema.names)

    return own.mapInArrow(read, schema)


def anchors(items: DataFrame, often: DataFrame, threshold: float, least: int) -> DataFrame:
    """(item, seed, check): of each item the rarest run of seeds that must hold a shared one.

    At most ``item_tokens - need`` tokens may stay uncovered, and a run of
    seeds that are all unshared leaves one token for each of them uncovered,
    but for the first ``least - 1``.
    """
    each = items.select("item", "item_tokens", F.posexplode(F.arrays_zip("seeds", "checks")).alias("q", "x")).select("item", "item_tokens", "q", F.col("x.seeds").alias("seed"), F.col("x.checks").alias("check"))
    counted = each.join(often, ["seed", "check"], "left").select("item", "item_tokens", F.struct("q", F.coalesce("n", F.lit(0)).alias("n"), "seed", "check").alias("x"))
    per = counted.groupBy("item", "item_tokens").agg(F.array_sort(F.collect_list("x")).alias("x"))  # one item's seeds

    @F.arrow_udf("int")
    def rarest(rows: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for own, width in zip(rows, widths.to_pylist(), strict=True):
            sums = np.concatenate(([0], np.cumsum(np.array(own.as_py(), np.int64))))
            out.append(int(np.argmin(sums[width:] - sums[:-width])))
        return pa.array(out, pa.int32())

    width = F.least(F.size("x"), (F.col("item_tokens") - F.ceil(F.col("item_tokens") * F.lit(threshold)) + least).cast("int"))
    placed = per.select("item", "x", width.alias("width")).select("item", "x", "width", rarest(F.col("x.n"), F.col("width")).alias("first"))
    return placed.select("item", F.explode(F.slice("x", F.col("first") + 1, F.col("width"))).alias("x")).select("item", "x.seed", "x.check").distinct()


def _tiled(pairs: DataFrame, threshold: float, least: int) -> DataFrame:
    """Pairs that reach the threshold, each row with both sides' seeds."""
    schema = T.StructType([pairs.schema["doc_id"], pairs.schema["digest"], pairs.schema["item_id"], *T._parse_datatype_string(_RESULT).fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            both = lambda i, a, b: np.stack([batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in (a, b)], 1)
            for i in range(len(batch)):
                places = batch.column("places")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                one = coverage(places, both(i, "seeds", "checks"), both(i, "own_seeds", "own_checks"), batch.column("item_tokens")[i].as_py(), threshold, least)
                if one:
                    keep.append(i)
                    found.append(one)
            taken = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "digest", "item_id")]
            kinds = [pa.float64()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], schema.names)

    return pairs.mapInArrow(judge, schema)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, least: int = 5, salts: int = 64) -> DataFrame:
    """One row per (document, item) whose coverage reaches the threshold, with the MD5 of the document's text."""
    numbered = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())  # noqa: E731  fixed once it is written
    items = materialize(numbered(item_seeds(benchmark, item_id, item_text, least), "item"), "items")
    hits = materialize(numbered(doc_hits(docs, doc_id, text, *bitmap(items), least), "doc"), "hits")
    seeds = hits.select("doc", F.explode(F.array_distinct(F.arrays_zip("seeds", "checks"))).alias("x")).select("doc", F.col("x.seeds").alias("seed"), F.col("x.checks").alias("check"))
    often = materialize(seeds.groupBy("seed", "check").agg(F.count("*").alias("n")), "often")
    marked = materialize(anchors(items, often, threshold, least), "anchors")  # so that its size is known to the join
    pairs = materialize(join_hot(seeds, marked, ["seed", "check"], salts, counts=often).select("doc", "item").distinct(), "pairs")
    own = items.select("item", "item_id", "item_tokens", F.col("seeds").alias("own_seeds"), F.col("checks").alias("own_checks"))
    return _tiled(join_hot(pairs, own, ["item"], salts).join(hits, "doc"), threshold, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``item_id``, coverage and the tiles' figures of each match."""
    return matches(docs, benchmark, **options).drop("digest")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that cover no item up to the threshold, null texts too.

    Equal texts cover the same items, so rows go by their text's MD5; where
    the matches are few, they are what is sent around and no text is shuffled.
    """
    gone = materialize(matches(docs, benchmark, text=text, **options).select(F.col("digest").alias("__scrubjay_gone")).distinct(), "contaminated")
    return docs.join(gone, F.md5(F.encode(F.col(text), "UTF-8")) == F.col("__scrubjay_gone"), "left_anti")
