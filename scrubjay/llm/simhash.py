"""SimHash near-duplicates, linked exactly through vantage-point trees.

Each text gets a 64-bit fingerprint; texts whose fingerprints differ in at
most ``radius`` bits are linked, and linked texts form a component.  Equal
fingerprints are made one row first, so thousands of copies cost no more than
one.  The distinct fingerprints are dealt out to shards by a vantage-point
tree: a node holds a vantage point v and a distance m, fingerprints within m
of v go inside, the rest outside.  By the triangle bound two fingerprints
within ``radius`` of one another have distances to v that differ by no more
than it, so it is enough to put those with a distance next to m on both sides:
every pair that is to be linked then shares a shard.  Shards are searched in
the same way until the ranges are small, and there by comparing all pairs.  A
shard reports a spanning star of each group it finds, never all pairs; Spark
then joins the stars to components.

A shard larger than ``block`` is compared block by block in several tasks, so
no task grows with a dense group.

Defined results: null and empty texts have fingerprint zero and are linked
like any other.  A component's id is its smallest id that is not null, or null
if all are.  Each row of the input gives one row, repeated rows too; extra
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import xxhash

from scrubjay.functions.columns import qcol
from scrubjay.llm.common import materialize

_SEED = 42
_SMALL = 384


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """Fingerprint (signed) of the lower-cased text's word shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, _SEED) for s in shingles], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """Fingerprint (bigint) of a text column."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint_of(x.as_py(), words) for x in texts), pa.int64())

    return compute(text)


# --- vantage-point trees -----------------------------------------------------


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _sides(distance: np.ndarray, cut: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points belong inside, and outside, of a node.

    For a pair on both sides, at cut - i and cut + j, i + j <= radius.  Those
    with i < ceil(radius / 2) are put outside too, those with
    j <= floor(radius / 2) inside too; a pair can't escape both.
    """
    outer = cut + 1 - (radius + 1) // 2
    return distance <= cut + radius // 2, distance >= outer


def _best_cut(distance: np.ndarray, radius: int) -> int:
    """A cut near the median that puts few points on both sides."""
    counts = np.bincount(distance, minlength=66).astype(np.int64)
    below = np.cumsum(counts)
    cuts = np.arange(65)
    inside = below[np.minimum(cuts + radius // 2, 65)]
    outside = below[-1] - np.where(cuts - (radius + 1) // 2 >= 0, below[np.maximum(cuts - (radius + 1) // 2, 0)], 0)
    return int(np.argmin(inside.astype(float) ** 2 + outside.astype(float) ** 2))


def _choose(points: np.ndarray, radius: int) -> tuple[np.uint64, int, float]:
    """Vantage point and cut that leave the least to compare, of a few candidates."""
    best = None
    for i in np.linspace(0, len(points) - 1, 8).astype(int):
        distance = _distance(points, points[i])
        cut = _best_cut(distance, radius)
        inside, outside = _sides(distance, cut, radius)
        cost = float(inside.sum()) ** 2 + float(outside.sum()) ** 2
        if best is None or cost < best[2]:
            best = points[i], cut, cost
    return best


def build_tree(sample: np.ndarray, levels: int, radius: int) -> list[tuple[int, int]]:
    """Vantage point and cut of every node of a tree, node k's children being 2k+1 and 2k+2."""
    nodes: list[tuple[int, int]] = []
    held = [sample]
    for k in range(2**levels - 1):
        points = held[k]
        vantage, cut, _ = _choose(points if len(points) else sample, radius)
        nodes.append((int(vantage), cut))
        inside, outside = _sides(_distance(points, vantage), cut, radius)
        held += [points[inside], points[outside]]
        held[k] = None
    return nodes


def shards_of(points: np.ndarray, nodes: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for every shard that a point belongs to."""
    rows, at = np.arange(len(points)), np.zeros(len(points), np.int64)
    if not nodes:
        return rows, at
    vantage, cut = np.array([v for v, _ in nodes], np.uint64), np.array([c for _, c in nodes], np.int64)
    for _ in range(int(math.log2(len(nodes) + 1))):
        inside, outside = _sides(np.bitwise_count(points[rows] ^ vantage[at]).astype(np.int64), cut[at], radius)
        rows, at = np.concatenate((rows[inside], rows[outside])), np.concatenate((2 * at[inside] + 1, 2 * at[outside] + 2))
    return rows, at - len(nodes)


def _roots(points: np.ndarray, radius: int) -> np.ndarray:
    """Index of a representative of each point's group, all pairs of a small range compared."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    labels, n = np.arange(len(points)), len(points)
    while True:
        lower = np.where(near, labels[None, :], n).min(1)
        lower = np.minimum(lower, lower[lower])
        if (lower == labels).all():
            return labels
        labels = lower


def stars(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(point, smaller point of its group) for distinct points, groups of one left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    waiting = [points]
    while waiting:
        part = waiting.pop()
        if len(part) > _SMALL:
            vantage, cut, _ = _choose(part, radius)
            inside, outside = _sides(_distance(part, vantage), cut, radius)
            if max(inside.sum(), outside.sum()) < 0.97 * len(part):
                waiting += [part[inside], part[outside]]
                continue
        for i in range(0, len(part), _SMALL):  # once, unless a dense range can't be split
            for j in range(i, len(part), _SMALL):
                both = part[i : i + _SMALL] if i == j else np.concatenate((part[i : i + _SMALL], part[j : j + _SMALL]))
                root = _roots(both, radius)
                for k in np.flatnonzero(root != np.arange(len(both))):
                    a, b = find(int(both[k])), find(int(both[root[k]]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def link(fingerprints: DataFrame, column: str = "fp", radius: int = 3, shard_size: int = 4096, block: int = 16384, most_shards: int = 16384) -> DataFrame:
    """Edges (a, b) whose components are those of all distinct fingerprints within ``radius`` bits.

    ``fingerprints`` must hold each fingerprint once.  The tree is made from a
    sample of about 64 fingerprints a shard (1024 at least); only its shape
    depends on the sample, never which pairs are found.
    """
    points = fingerprints.select(F.col(column).alias("fp"))
    total = points.count()
    levels = max(0, math.ceil(math.log2(min(most_shards, max(1, total / shard_size)))))
    nodes: list[tuple[int, int]] = []
    if levels:
        every = max(1, total // max(1024, 64 * 2**levels))
        drawn = points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).collect()
        sample = np.unique(np.array([r.fp for r in drawn], np.int64)).view(np.uint64)
        nodes = build_tree(sample, levels, radius) if len(sample) else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 1 << 14):
                part = values[i : i + (1 << 14)]
                rows, shard = shards_of(part.view(np.uint64), nodes, radius)
                yield pa.record_batch({"shard": shard.astype(np.int64), "fp": part[rows]})

    dealt = points.mapInArrow(deal, "shard long, fp long")
    # a shard that outgrew its block is compared as pairs of blocks
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = {r.shard: -(-r.n // block) for r in sizes.collect()}
    own, first, second = F.lit(0), F.lit(0), F.lit(0)
    if blocks:
        parts = F.coalesce(F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv))[F.col("shard")], F.lit(1))
        own = F.pmod(F.xxhash64("fp"), parts)
        dealt = dealt.select("shard", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("other"))
        first, second = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("shard", first.cast("long").alias("first"), second.cast("long").alias("second"), "fp")

    def search(table: pa.Table) -> pa.Table:
        found = stars(table.column("fp").to_numpy().astype(np.int64).view(np.uint64), radius)
        return pa.table({"a": _signed([x for x, _ in found]), "b": _signed([r for _, r in found])})

    return dealt.groupBy("shard", "first", "second").applyInArrow(search, "a long, b long")


# --- components --------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, the root being its component's smallest node.

    Large-star and small-star steps by turns: each node hands the smallest
    node it knows of to its larger neighbours, then to its smaller ones, until
    all edges lead to the roots.  A node with very many edges is a skewed
    join key, which Spark splits.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (bigint) and ``component_id`` of every row of ``docs``."""
    marked = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    return components_of(marked, radius)


def components_of(marked: DataFrame, radius: int = 3) -> DataFrame:
    """``component_id`` for rows of (doc_id, fp)."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(link(distinct, radius=radius)).withColumnRenamed("node", "fp")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    A row without an id stays only if its whole component has none; of rows
    alike in id and fingerprint one stays.  All columns are kept.  The rows are
    written once with their fingerprint and a number, by which those that stay
    are picked in one shuffle.
    """
    fp, row = "__scrubjay_fp", "__scrubjay_row"
    marked = materialize(docs.withColumns({fp: fingerprint(F.col(text), words), row: F.monotonically_increasing_id()}), "fingerprinted")
    first = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"))
    distinct = materialize(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(first).alias("best")), "distinct")
    roots = components(link(distinct, radius=radius)).withColumnRenamed("node", "fp")
    kept = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best")["row"].alias(row)).select(row)
    return marked.join(kept, row, "left_semi").select(*map(qcol, docs.columns))
