"""Byte-level BPE in linear time by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
strings finds every vocabulary token in a pre-token at one pass.  The encoder
takes the longest token at each place; a token may follow another only if the
merges, applied to both together, would leave that pair alone.  Whether they
do is worked out from each token's own last merge and remembered.  Where a
token may not follow, the next shorter one is tried, and where none may, the
last token is taken back; places known to lead nowhere are not tried again, so
work stays linear in the text.  The result is what the merges give.

Defined results: null and empty texts have no ids and decode to no bytes.
Whole texts are encoded, of any length; special strings in a text are ordinary
text.  Rows are encoded one by one, so repeated rows are equal and extra
columns never read.
"""

from __future__ import annotations

from array import array
import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_LONGEST_KEPT = 64
_MOST_PAIRS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines with base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder for a rank table; twice ``cache_size`` bounds the remembered pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 100_000):
        self.find = regex.compile(pattern).findall
        self.ranks, self.cache_size = ranks, cache_size
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.most = max(map(len, ranks))
        top = max(ranks.values()) + 1
        self.text_rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.size_of = [0] * top
        self.shorter = [-1] * top  # next shorter token that begins a token
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) is not None), -1)
        self.sizes = np.array(self.size_of, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        by_rank = {rank: token for token, rank in ranks.items()}
        self.laid = np.frombuffer(b"".join(by_rank.get(rank, b"") for rank in range(top)), np.uint8)
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the cache before it was full; what is still in use moves on
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._learn(token, rank)

    def _learn(self, token: bytes, rank: int) -> None:
        """Find the two tokens whose merge makes this one; the ranks before it are known already."""
        if len(token) == 1:
            self.halves[rank] = (rank, rank)
            return
        for i in range(1, len(token)):
            left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if left is not None and right is not None and left < rank and right < rank and self._may_follow(left, right):
                self.pair[left, right] = rank
                self.halves[rank] = (left, right)
                return
        self.halves[rank] = (rank, rank)  # no merge reaches it

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens together leaves just these two.

        From the seam outwards, the pair of neighbours at each stage of the
        two tokens' own merges is looked up: a merge across the seam would
        come first if its rank is below that of the merge done next.
        """
        limit = len(self.ranks) + 1
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:  # a byte: go on with the other side
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def _learn_fit(self, left: int, right: int) -> bool:
        """Work out whether one token may follow another, and remember it."""
        if len(self.fits) >= _MOST_PAIRS:
            self.fits.clear()
        good = self.fits[left << 32 | right] = self._may_follow(left, right)
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None and (len(piece) == 1 or self.halves[whole] != (whole, whole)):
            return [whole]
        n, text = len(piece), piece.decode("latin-1")
        fits, ids, at, last = self.fits.get, [], 0, -1
        # the longest match at each place in turn, as far as they fit
        for _, (size, rank) in self.automaton.iter_long(text):
            if last >= 0:
                good = fits(last << 32 | rank)
                if good is None:
                    good = self._learn_fit(last, rank)
                if not good:
                    break
            ids.append(rank)
            at += size
            last = rank
        if at == n:
            return ids
        open_ = bytearray(b"\1") * (n + 1)  # places from which the end may still be reached
        size_of, shorter, rank_of = self.size_of, self.shorter, self.text_rank.get
        most, prefix = self.most, self.automaton.longest_prefix
        while True:
            end = at + size_of[rank]
            if open_[end]:
                good = True
                if last >= 0:
                    good = fits(last << 32 | rank)
                    if good is None:
                        good = self._learn_fit(last, rank)
                if good:
                    ids.append(rank)
                    if end == n:
                        return ids
                    at, last = end, rank
                    size = prefix(text[at : at + most])
                    while (rank := rank_of(text[at : at + size])) is None:
                        size -= 1
                    continue
            rank = shorter[rank]
            while rank < 0:  # nothing fits here: take the last token back
                open_[at] = 0
                if not ids:
                    raise ValueError("this piece has no valid encoding")
                gone = ids.pop()
                at -= size_of[gone]
                last = ids[-1] if ids else -1
                rank = shorter[gone]

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32) of a whole text."""
        cache, pieces = self.cache, self.find(text)
        found = list(map(cache.get, pieces))
        try:
            return np.frombuffer(b"".join(found), np.int32)
        except TypeError:  # some aren't known
            pass
        old = self.old
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                ids = cache.get(piece) or old.get(piece)
                if ids is None:
                    ids = array("i", self.encode_piece(piece.encode())).tobytes()
                found[i] = ids
                if len(piece) <= _LONGEST_KEPT:
                    if len(cache) >= self.cache_size:
                        self.old, self.cache = cache, {}
                        old, cache = self.old, self.cache
                    cache[piece] = ids
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from the tokens laid end to end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.laid[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(2)
def _coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


def _id_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def encode(text: Column, ranks_file: str, pattern: str) -> Column:
    """Ids (array<int>) of a text column; the file must be readable by every executor."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = _coder(ranks_file, pattern)
        return _id_array([coder.encode(x.as_py() or "") for x in texts])

    return ids(text)


def round_trip(text: Column, ranks_file: str, pattern: str) -> Column:
    """``ids`` of a text column and the ``data`` (binary) that they decode to.

    One function does both: Spark would encode twice if the ids were asked for
    beside what another function makes of them.
    """

    @F.arrow_udf("struct<ids:array<int>,data:binary>")
    def both(texts: pa.Array) -> pa.Array:
        coder = _coder(ranks_file, pattern)
        rows = [coder.encode(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([_id_array(rows), pa.array(map(coder.decode, rows), pa.binary())], ["ids", "data"])

    return both(text)


def decode(ids: Column, ranks_file: str, pattern: str) -> Column:
    """Bytes (binary) of an id column; null stays null."""

    @F.arrow_udf("binary")
    def data(rows: pa.Array) -> pa.Array:
        coder = _coder(ranks_file, pattern)
        return pa.array((None if x.values is None else coder.decode(x.values.to_numpy()) for x in rows), pa.binary())

    return data(ids)
