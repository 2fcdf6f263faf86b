"""Token counts by a SentencePiece BPE model, with a shortcut for whole tokens.

The model puts a mark before the text and in place of each space.  No piece
has a mark after another character, so merges never cross from a character
into the mark that follows: the text can be cut there into pre-tokens and each
counted alone (:func:`check_model` proves this for a given model, and that the
model leaves text as it is otherwise).  Vocabulary strings that encode alone
as exactly one token are proved beforehand by encoding each of them; a
pre-token among them counts one without any merge.  Only the other ones are
merged, by the library itself, once for as long as they stay in a bounded
cache.

Defined results: null and empty texts have 0 bytes and 0 tokens.  Whole texts
count, of any length; special strings in a text are ordinary text.  Rows are
counted one by one, so repeated rows are equal and extra columns never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "▁"
#: Pre-tokens with more spaces in front than one are cut by this pattern.
_PRETOKEN = re.compile(" +[^ ]*")
_LONGEST_KEPT = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


# Fields of the model's description, and the kind of a piece that a user defined.
_PIECES, _NORMALIZER, _CHARSMAP, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES, _PIECE_KIND, _USER_DEFINED = 1, 3, 2, 3, 4, 5, 3, 4


def check_model(model) -> None:
    """Raise unless texts may be cut before every mark that follows another character, by the model's own description."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(_MARK in piece.lstrip(_MARK) for piece in pieces):
        raise ValueError("a piece of this model reaches across a word's start")
    described = list(_fields(model.serialized_model_proto()))
    if any(dict(_fields(x)).get(_PIECE_KIND) == _USER_DEFINED for n, x in described if n == _PIECES):
        raise ValueError("a piece of this model was defined by a user and is cut out first")
    rules = {_DUMMY_PREFIX: 1, _REMOVE_SPACES: 1, _ESCAPE_SPACES: 1} | dict(_fields(next((x for n, x in described if n == _NORMALIZER), b"")))
    if rules.get(_CHARSMAP) or rules[_REMOVE_SPACES] or not rules[_DUMMY_PREFIX] or not rules[_ESCAPE_SPACES]:
        raise ValueError("this model changes texts before it encodes them")


def whole_tokens(model) -> frozenset[str]:
    """Words (without the mark before them) that encode alone as exactly one token, each one tried."""
    words = [p[1:] for i in range(model.get_piece_size()) if not model.is_byte(i) and (p := model.id_to_piece(i))[0] == _MARK]
    words = [w for w in words if w and _MARK not in w]
    return frozenset(w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class TokenCounter:
    """Counts tokens of texts; ``cache_size`` bounds how many merged pre-tokens are remembered."""

    def __init__(self, model_file: str, cache_size: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_model(self.model)
        self.whole = dict.fromkeys(whole_tokens(self.model), 1) | {"": 1}  # a mark alone; the library takes "" for no text
        self.known = dict(self.whole)
        self.cache_size = cache_size

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """Pre-tokens, each without the one mark that all of them begin with."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or _MARK in text:
            return [x[1:] for x in _PRETOKEN.findall(" " + text.replace(_MARK, " "))]
        return text.split(" ")

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.pretokens(text) if text else [] for text in texts]
        if len(self.known) > self.cache_size:
            self.known = dict(self.whole)
        known = self.known
        new = set()
        for words in cut:
            new.update(words)
        rest = [w for w in new if w not in known]
        counts = [len(ids) for ids in self.model.encode(rest, num_threads=1)] if rest else []
        more = dict(zip(rest, counts, strict=True))
        for word, n in more.items():
            if len(word) <= _LONGEST_KEPT:
                known[word] = n
        if any(len(w) > _LONGEST_KEPT for w in rest):
            return [sum(known[w] if w in known else more[w] for w in words) for words in cut]
        return [sum(map(known.__getitem__, words)) for words in cut]


@lru_cache(2)
def _counter(model_file: str, cache_size: int) -> TokenCounter:
    return TokenCounter(model_file, cache_size)


def token_count(text: Column, model_file: str, cache_size: int = 300_000, texts_at_once: int = 256) -> Column:
    """Number of tokens of a text column (bigint).

    ``model_file`` must be readable by every executor, as a file installed
    with the tokenizers is.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counter = _counter(model_file, cache_size)
        return pa.array((n for i in range(0, len(texts), texts_at_once) for n in counter.count(texts.slice(i, texts_at_once).to_pylist())), pa.int64())

    return count(text)
