"""Merkle manifest of a dataset: a tree of digests a group, a tree over the groups, a proof for every row.

Leaves are numbered within their group by a sort over ranges of (group, id):
Spark deals the ranges, each part counts its own rows, and a small table of
counts a part says where each part's numbers begin.  Trees grow by
``combineByKey``: a key is a block of 512 consecutive nodes of a group, its
combiner holds the parents begun so far with their children by index.  How many
children a parent waits for follows from the group's size, so a parent that has
them all is hashed at once and becomes a child of its own parent.  As leaves
come sorted, all but the blocks at a part's edges are whole before the shuffle;
the frontiers of the others meet behind it.  The blocks' tops are the leaves of
the next round, 512 times fewer, until each group has one.

A block keeps the children of all of its parents, which are the links back
down.  Paths go down them round by round: a block gets the path of its top, and
hands one to each of its nodes; the last step proves each leaf of a block.

Defined results: a group of one row has that row's leaf as its root.  Rows with
equal ids are ordered by their leaves, those without an id come first; each row
is a leaf, repeated rows too.  A null group is a group like any other, before
all others.  Empty tables give no rows.  Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
import hashlib

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import materialize

ARITY = 8
#: Levels of a block: a combiner holds at most ARITY ** LEVELS nodes and their parents.
LEVELS = 3
BLOCK = ARITY**LEVELS

_PATH = "array<struct<at:int,others:array<string>>>"
_BLOCKS = "gid long, block long, size long, nodes array<array<string>>, ids array<long>, altered array<string>"


def digest(parts: Iterator[str] | list[str]) -> str:
    """sha256 (lowercase hex) of digests as text, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Digest of a row's values: ``-`` for null, else UTF-8 length, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


# --- numbering ---------------------------------------------------------------


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``gid`` (a number of the group), ``idx`` (0-based within it) and ``size`` (of the group)."""
    keys = [group, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ordered").withColumn("__part", F.shiftright("__at", 33))
    spans = dealt.groupBy(group, "__part").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)  # a row for each part that holds the group
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col(group).alias("__group"),
        F.col("__part").alias("__in"),
        F.min("first").over(whole).alias("gid"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"),
        F.sum("n").over(whole).alias("size"),
    )
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__in"))
    return dealt.join(spans, same).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__group", "__in", "__shift")


# --- trees -------------------------------------------------------------------


class Frontier:
    """What is known of a block: parents with their children by index, and what its leaves carry along."""

    __slots__ = ("parents", "carried")

    def __init__(self):
        self.parents: dict[tuple[int, int], dict[int, str]] = {}
        self.carried: dict[int, tuple] = {}

    def add(self, level: int, index: int, value: str, size: int) -> None:
        """A node of the block at a level, of ``size`` ones that the group has there; whole parents follow."""
        while True:
            children = self.parents.setdefault((level + 1, index // ARITY), {})
            children[index] = value
            if size == 1 or level == LEVELS or len(children) < min(ARITY, size - index // ARITY * ARITY):
                return  # the top, or a parent that waits
            value = digest(children[i] for i in sorted(children))
            level, index, size = level + 1, index // ARITY, -(-size // ARITY)

    def merge(self, other: Frontier, size: int) -> Frontier:
        """Children that met only now make their parents whole."""
        self.carried.update(other.carried)
        for (level, parent), theirs in sorted(other.parents.items()):
            mine = self.parents.setdefault((level, parent), {})
            for index in theirs.keys() - mine.keys():
                self.add(level - 1, index, theirs[index], -(-size // ARITY ** (level - 1)))
        return self

    def levels(self) -> list[list[str]]:
        """Digests of the nodes of each level, from the block's leaves to its top."""
        out: list[dict[int, str]] = []
        for (level, _), children in self.parents.items():
            while len(out) < level:
                out.append({})
            out[level - 1].update(children)
        return [[nodes[i] for i in sorted(nodes)] for nodes in out]


def _combined(nodes: RDD, parts: int) -> RDD:
    """Blocks of (gid, idx, size, digest, carried...) nodes."""

    def begin(node: tuple) -> tuple[int, Frontier]:
        return more((node[2], Frontier()), node)

    def more(held: tuple[int, Frontier], node: tuple) -> tuple[int, Frontier]:
        _, index, size, value, *carried = node
        held[1].carried[index] = tuple(carried)
        held[1].add(0, index, value, size)
        return held

    def meet(one: tuple[int, Frontier], two: tuple[int, Frontier]) -> tuple[int, Frontier]:
        return one[0], one[1].merge(two[1], one[0])

    def row(item: tuple) -> tuple:
        (gid, block), (size, frontier) = item
        carried = [frontier.carried[i] for i in sorted(frontier.carried)]
        return gid, block, size, frontier.levels(), [c[0] for c in carried], [c[1] for c in carried]

    keyed = nodes.map(lambda r: ((r[0], r[1] // BLOCK), tuple(r)))
    return keyed.combineByKey(begin, more, meet, parts).map(row)


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and the root of each group (``gid``, ``root``), from ``gid idx size digest id altered`` nodes."""
    spark = nodes.sparkSession
    rounds, roots = [], []
    while True:
        parts = max(nodes.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = materialize(spark.createDataFrame(_combined(nodes.rdd, parts), _BLOCKS, verifySchema=False), f"blocks{len(rounds)}")
        rounds.append(blocks)
        tops = blocks.select("gid", F.col("block").alias("idx"), F.ceil(F.col("size") / BLOCK).alias("size"), F.element_at(F.element_at("nodes", -1), 1).alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("altered"))
        roots.append(tops.where("size = 1").select("gid", F.col("digest").alias("root")))
        nodes = tops.where("size > 1")
        if nodes.isEmpty():
            return rounds, reduce(DataFrame.union, roots)


# --- proofs ------------------------------------------------------------------


def _steps(nodes: list[list[str]], index: int, size: int) -> list[tuple[int, list[str]]]:
    """Place and siblings of a block's leaf, level by level up to the block's top."""
    out, level = [], 0
    while size > 1 and level < LEVELS:
        start = index // ARITY * ARITY
        run = nodes[level][start : start + ARITY]
        out.append((index - start, run[: index - start] + run[index - start + 1 :]))
        index, size, level = index // ARITY, -(-size // ARITY), level + 1
    return out


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, idx, id, node, path, top, sub) for each leaf of blocks that have a path."""
    schema = pa.schema([("gid", pa.int64()), ("idx", pa.int64()), ("id", pa.int64()), ("node", pa.string()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))), ("top", pa.string()), ("sub", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            above = [(s["at"], s["others"]) for s in row["path"]]
            out = []
            for i, node in enumerate(row["nodes"][0]):
                path = _steps(row["nodes"], i, row["size"]) + above
                out.append({"gid": row["gid"], "idx": row["block"] * BLOCK + i, "id": row["ids"][i], "node": node, "path": [{"at": a, "others": o} for a, o in path], "top": row["top"], "sub": row["sub"]})
            yield pa.RecordBatch.from_pylist(out, schema)


def prove(nodes: list[list[str]], size: int, above: list[tuple[int, list[str]]], altered: list[str | None]) -> tuple[list[str], list[str]]:
    """For each leaf of a block: digest of its siblings up to the root, and the root folded from the altered leaf."""
    tail = "".join(x for _, others in above for x in others)
    proofs, folded = [], []
    for i, value in enumerate(altered):
        steps = _steps(nodes, i, size)
        proofs.append(digest([*(x for _, others in steps for x in others), tail]))
        now = value if value is not None else nodes[0][i]
        for at, others in (*steps, *above):
            now = digest([*others[:at], now, *others[at:]])
        folded.append(now)
    return proofs, folded


def children(placed: DataFrame) -> DataFrame:
    """The leaves of blocks, each with its own path."""
    return placed.mapInArrow(_children, f"gid long, idx long, id long, node string, path {_PATH}, top string, sub string")


_PROVED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            leaves, root = row["nodes"][0], row["top"]
            proofs, folded = prove(row["nodes"], row["size"], [(s["at"], s["others"]) for s in row["path"]], row["altered"])
            n = len(leaves)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(row["ids"], pa.int64()),
                "leaf": leaves,
                "subroot": [row["sub"]] * n,
                "root": [root] * n,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [x == root for x in folded],
            })


def descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The first round's blocks with the ``path`` above their tops, the ``top`` of it all and the group's own root (``sub``).

    ``paths`` has ``gid``, the ``path`` above the group's root, ``top`` and ``sub``.
    """
    placed = None
    for blocks in reversed(rounds):
        ended = blocks.where(F.col("size") <= BLOCK).join(paths, "gid")
        if placed is not None:
            above = children(placed).select("gid", F.col("idx").alias("block"), "path", "top", "sub")
            ended = ended.unionByName(blocks.where(F.col("size") > BLOCK).join(above, ["gid", "block"]))
        placed = ended
    return placed


def manifest(rows: DataFrame, id_column: str, group: str, leaf_column: str, altered: str) -> DataFrame:
    """``id leaf subroot root proof_sha256 folded_root verified`` of every row.

    ``altered`` names a column with the leaf that a row has now, null where it
    is as it was; the root is folded from it along the row's proof.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(id_column).cast("long").alias("id"), F.col(leaf_column).alias("digest"), F.col(altered).alias("altered"))
    nodes = numbered(rows, "g", ["id", "digest"]).select("g", "gid", "idx", "size", "digest", "id", "altered")
    rounds, roots = grow(nodes.drop("g"))
    names = nodes.where("idx = 0").select("g", "gid")
    tops = names.join(roots, "gid").select(F.lit(0).alias("all"), "g", F.col("gid").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("altered"))
    upper, root = grow(numbered(tops, "all", ["g"]).select("gid", "idx", "size", "digest", "id", "altered"))
    start = root.select("gid", F.array().cast(_PATH).alias("path"), F.col("root").alias("top"), F.col("root").alias("sub"))
    groups = children(descend(upper, start)).select(F.col("id").alias("gid"), "path", "top", F.col("node").alias("sub"))
    return descend(rounds, groups).mapInArrow(_proved, _PROVED)
