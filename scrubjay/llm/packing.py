"""Pack documents into windows of token ids, each with what reads most like it.

A document's ids are cut at each full window; what is left over is a fragment.
Fragments are sorted by a signature of their ids (two min-hashes, so that texts
with much in common lie close together) and dealt to shards of bounded size by
ranges of it.  A shard holds a BM25 inverted index of its fragments' ids.  A
window begins with a seed, the index ranks the fragments that aren't used yet,
and the window takes them in that order as long as they fit; the space that
stays is filled by cutting the best of the others, whose rest is the next seed.
What is left at a shard's end is cut into sequences of powers of two, which
need no padding.

A hot signature does no harm: ties are broken by the fragment's number, so
ranges stay even, and no shard holds more than ``shard`` fragments.

Ids are those of the ``tokenizers`` file.  They are made by the ranks of the
same vocabulary, which is faster; texts with runs of white space that are too
long for that go to the library itself.

Defined results: null and empty texts are the end id alone.  Each row is a
document, repeated rows too; special strings in a text are their ids.  Extra
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import tiktoken
from tokenizers import Tokenizer

from scrubjay.llm.byte_bpe import load_ranks
from scrubjay.llm.common import materialize

_LONG_SPACE = re.compile(r"\s{5000}")
K1, B = 1.2, 0.75


class Ids:
    """Ids of texts by a vocabulary that is there both as a ``tokenizers`` file and as ranks."""

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str):
        self.library = Tokenizer.from_file(tokenizer_file)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_file), special_tokens=special)

    def of(self, text: str | None) -> np.ndarray:
        """Ids (uint32) of a whole text."""
        if not text:
            return np.empty(0, np.uint32)
        if _LONG_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)


@lru_cache(1)
def _ids(*files: str) -> Ids:
    return Ids(*files)


def signature(ids: np.ndarray) -> int:
    """Two min-hashes of the set of ids, one after the other."""
    ids = ids.astype(np.uint64)
    hashed = [int(((ids + np.uint64(1)) * np.uint64(odd) % np.uint64(2**61 - 1) >> np.uint64(20) & np.uint64(2**31 - 1)).min()) for odd in (0x9E3779B97F4A7C15 >> 18, 0xC2B2AE3D27D4EB4F >> 18)]
    return hashed[0] << 31 | hashed[1]


def chunks(docs: DataFrame, doc_id: str, text: str, files: tuple[str, str, str], window: int, end_id: int) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, signature): full windows without a signature, and what is left over with one.

    Ids are bytes, four for each id, the lowest first.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["doc_id"], *T._parse_datatype_string("start long, ids binary, doc_tokens long, signature long").fields])
    end = np.array([end_id], np.uint32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ids(*files)
        for batch in batches:
            at, starts, ids, sizes, marks = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                found = np.concatenate((coder.of(value.as_py()), end)).astype("<u4")
                for start in range(0, len(found), window):
                    part = found[start : start + window]
                    at.append(i)
                    starts.append(start)
                    ids.append(part.tobytes())
                    sizes.append(len(found))
                    marks.append(None if len(part) == window else signature(part))
            columns = pa.array(starts, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], schema.names)

    return own.mapInArrow(read, schema)


# --- shards ------------------------------------------------------------------


class Index:
    """BM25 over the ids of a shard's fragments."""

    def __init__(self, fragments: list[np.ndarray]):
        n = len(fragments)
        held = [np.unique(x, return_counts=True) for x in fragments]
        self.terms = [t for t, _ in held]
        sizes = np.array([len(x) for x in fragments], float)
        owner = np.repeat(np.arange(n), [len(t) for t in self.terms])
        terms, tf = np.concatenate(self.terms), np.concatenate([c for _, c in held]).astype(float)
        order = np.argsort(terms, kind="stable")
        self.owner, terms, tf = owner[order], terms[order], tf[order]
        self.names, self.starts, df = np.unique(terms, return_index=True, return_counts=True)
        self.ends = self.starts + df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.owner])

    def scores(self, seed: int) -> np.ndarray:
        """Score of every fragment for the seed's ids."""
        at = np.searchsorted(self.names, self.terms[seed])
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return np.bincount(self.owner[places], self.weight[places], len(self.terms))


def fill(fragments: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (fragment, start in it, length); each is a full window, or a power of two at the end."""
    index = Index(fragments)
    left = np.array([len(x) for x in fragments])
    start = np.zeros(len(fragments), np.int64)
    unused, first, seed = np.ones(len(fragments), bool), 0, -1
    while True:
        if seed < 0:
            while first < len(unused) and not unused[first]:
                first += 1
            if first == len(unused):
                return
            seed = first
        unused[seed] = False
        row, space = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        ranked = np.argsort(-index.scores(seed), kind="stable")
        ranked = ranked[unused[ranked]]
        seed, at = -1, 0
        while space and len(ranked):
            fits = np.flatnonzero(left[ranked[at:]] <= space)
            if not len(fits):
                break
            at += int(fits[0])
            taken = int(ranked[at])
            row.append((taken, int(start[taken]), int(left[taken])))
            space -= int(left[taken])
            unused[taken] = False
            at += 1
        rest = ranked[unused[ranked]]
        if space and len(rest):  # the best of those that didn't fit is cut
            seed = int(rest[0])
            row.append((seed, int(start[seed]), space))
            start[seed] += space
            left[seed] -= space
            space = 0
        if not space:
            yield row
            continue
        yield from powers(row)


def powers(row: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a row in sequences whose lengths are falling powers of two."""
    total = sum(n for _, _, n in row)
    waiting = row[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            piece, start, n = waiting.pop()
            if n > size:
                waiting.append((piece, start + size, n - size))
                n = size
            out.append((piece, start, n))
            size -= n
        yield out


def packed(fragments: DataFrame, window: int, shard: int) -> DataFrame:
    """Pieces of fragments (``chunk`` numbers them) in windows, shard by shard in the order of their signatures."""
    near = fragments.repartitionByRange("signature", "chunk").sortWithinPartitions("signature", "chunk")
    near = near.select("doc_id", "start", "ids", "doc_tokens", "chunk")
    schema = T.StructType([near.schema["doc_id"], *T._parse_datatype_string("start long, ids binary, doc_tokens long, sequence_id long, offset long").fields])

    def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        starts, sizes, numbers = (table.column(c).to_numpy() for c in ("start", "doc_tokens", "chunk"))
        ids = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("ids")]
        at, own, parts, sequence, offsets = [], [], [], [], []
        for row in fill(ids, window):
            name, offset = int(numbers[row[0][0]]) * window + row[0][1], 0
            for i, start, n in row:
                at.append(i)
                own.append(int(starts[i]) + start)
                parts.append(ids[i][start : start + n].tobytes())
                sequence.append(name)
                offsets.append(offset)
                offset += n
        columns = pa.array(own, pa.int64()), pa.array(parts, pa.binary()), pa.array(sizes[at], pa.int64()), pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64())
        doc_ids = table.column("doc_id").take(pa.array(at, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([doc_ids, *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while n + len(batch) >= shard:
                yield pieces([*held, batch.slice(0, shard - n)])
                batch, held, n = batch.slice(shard - n), [], 0
            if len(batch):
                held.append(batch)
                n += len(batch)
        if held:
            yield pieces(held)

    return near.mapInArrow(run, schema)


def pack(docs: DataFrame, files: tuple[str, str, str], doc_id: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0, shard: int = 1024) -> DataFrame:
    """``doc_id start ids doc_tokens sequence_id offset`` of each piece, its ids as bytes.

    ``files`` are the tokenizer's file, its ranks and the pattern that parts
    texts; ``window`` is a power of two.
    """
    cut = materialize(chunks(docs, doc_id, text, files, window, end_id).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    whole = cut.where(F.col("signature").isNull()).select("doc_id", "start", "ids", "doc_tokens", (F.col("chunk") * window).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.union(packed(cut.where(F.col("signature").isNotNull()), window, shard))
