"""Byte-level BPE encoding and decoding in linear time.

A text is split by a pattern and each match is encoded by itself. A token is a byte string with a rank; the
merges join, again and again, the neighbours whose union has the least rank, the leftmost first. Their result
is found without doing them: a sequence of tokens is what the merges leave if and only if every two
neighbours are, and whether two are can be read from how the merges built them. So a match is covered
from the left by the longest token, shorter ones are tried where the neighbours don't fit, and a place from
where no cover goes on is never tried again. The bytes of a match are Latin-1 characters to an Aho-Corasick
automaton of the reversed tokens; one pass over the reversed match gives the longest token at every place.
Compatible neighbours and encoded matches are remembered up to a bound.

Nulls: a null text is the empty text, which has no ids; a null id is kept; null ids decode to null. Texts
of any length are split some hundred thousand characters at a time, so the pieces held are bounded; one
match of any length takes time in proportion to it. There are no ties: ids depend on the text alone.
Repeated rows are encoded each. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import fields, limit_batches

_MATCHES = 200_000
_PAIRS = 400_000
_CHARACTERS = 400_000
_OUT_BYTES = 8_000_000
_REMEMBERED = 64


class Vocabulary:
    """The tokens of a rank file and what the merges do with them.

    ``parts[t]`` are the two tokens that the merges join last when they make ``t`` (``t`` itself for single
    bytes); ``shorter[t]`` is the longest proper beginning of ``t`` that is a token too, or -1.
    In a trained vocabulary the merges make every token from older ones; any other is refused.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.size = list(map(len, self.token))
        self.parts = [(-1, -1)] * len(self.token)
        self.shorter = [-1] * len(self.token)
        self.union: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.token):
            if not token:
                continue
            self.parts[rank] = self._split(rank, token)
            automaton.add_word(token[::-1].decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        automaton.make_automaton()
        self.automaton = automaton

    def _split(self, rank: int, token: bytes) -> tuple[int, int]:
        """The pair of older tokens that the merges leave just before they make ``token``."""
        if len(token) == 1:
            return rank, rank
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n], rank), self.ranks.get(token[n:], rank)
            if a < rank and b < rank and self._stay_apart(a, b):
                self.union[a, b] = rank
                return a, b
        raise ValueError(f"no merge of older tokens makes {token!r}")

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of ``a`` and ``b`` end with these two tokens.

        The last merge on either side is undone step by step. A pair that faces the border is merged across it if
        its union came before the merges that used up its halves: those on the left come first if equal.
        """
        bound = len(self.token)
        while True:
            if self.union.get((a, b), bound) < bound:
                return False
            whole_a, whole_b = self.size[a] == 1, self.size[b] == 1
            if whole_a and whole_b:
                return True
            # The younger token was merged last; of two equal ones the right.
            if not whole_a and (a > b or whole_b):
                bound, a = a, self.parts[a][1]
            else:
                bound, b = b + 1, self.parts[b][0]

    def fit(self, a: int, b: int) -> bool:
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) >= _PAIRS:
                self._fits.clear()
            found = self._fits[a, b] = self._stay_apart(a, b)
        return found

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match, as the merges would leave them."""
        n = len(data)
        longest = [-1] * n
        for end, rank in self.automaton.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0:  # the longest of a place comes first
                longest[at] = rank
        ids: list[int] = []
        dead = bytearray(n + 1)
        size, shorter = self.size, self.shorter
        at, rank = 0, longest[0]
        while at < n:
            while rank >= 0 and (dead[at + size[rank]] or (ids and not self.fit(ids[-1], rank))):
                rank = shorter[rank]
            if rank >= 0:
                ids.append(rank)
                at += size[rank]
                rank = longest[at] if at < n else -1
            elif ids:
                dead[at] = 1
                rank = ids.pop()
                at -= size[rank]
            else:
                raise ValueError("a byte without a token")
        return ids


class _Matches(dict):
    """Ids of a match as little-endian bytes, remembered; emptied when it outgrows its bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.vocabulary.encode(match.encode()), "<u4").tobytes()
        if len(match) <= _REMEMBERED:
            if len(self) >= _MATCHES:
                self.clear()
            self[match] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str) -> Vocabulary:
    """The vocabulary of a file of lines ``base64(token) rank``; loaded once per worker."""
    with open(ranks_path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    import regex

    matches, find = _Matches(vocabulary(ranks_path)), regex.compile(pattern).findall

    def encode(text: str) -> bytes:
        return b"".join(b"".join(map(matches.__getitem__, part)) for part in split_text(find, text))

    return encode


def split_text(find: Callable, text: str, width: int = _CHARACTERS) -> Iterator[list[str]]:
    """The matches of a text, some of them at a time.

    The last match of a part may depend on what follows, so the next part starts with it. The pattern
    looks ahead one character at most and leaves no character out.
    """
    at, step = 0, width
    while at < len(text):
        found = find(text, at, at + step)
        if at + step < len(text):
            found.pop()
            if not found:  # one match is longer than the part
                step *= 2
                continue
        yield found
        at += sum(map(len, found))
        step = width


def _in_parts(batches: Iterator, column: str, names: list[str], encode: Callable) -> Iterator:
    """Batches of ``doc_id`` and what ``encode`` makes of a column, of some megabytes at most each."""
    import pyarrow as pa

    for batch in batches:
        ids, values = batch.column("doc_id"), batch.column(column)
        begin, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append(encode(values[i]))
            size += len(held[-1] or b"")
            if size >= _OUT_BYTES or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(begin, i + 1 - begin), pa.array(held, pa.binary())], names=names)
                begin, held, size = i + 1, [], 0


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers, one after the other."""
    limit_batches(docs.sparkSession)
    schema = fields(("doc_id", docs.schema["doc_id"].dataType), ("ids", "binary"))

    def encoded(batches: Iterator) -> Iterator:
        encode = _encoder(ranks_path, pattern)
        yield from _in_parts(batches, "text", schema.names, lambda text: encode(text.as_py() or ""))

    return docs.select("doc_id", "text").mapInArrow(encoded, schema)


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids of every document stand for."""
    limit_batches(encoded.sparkSession)
    schema = fields(("doc_id", encoded.schema["doc_id"].dataType), ("ids", "binary"), ("decoded", "binary"))

    def decoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token = vocabulary(ranks_path).token.__getitem__

        def decode(ids) -> bytes | None:
            whole = ids.as_py()
            return None if whole is None else b"".join(map(token, np.frombuffer(whole, "<u4").tolist()))

        for batch in batches:
            begin = 0
            for part in _in_parts(iter([batch]), "ids", ["doc_id", "decoded"], decode):
                ids = batch.column("ids").slice(begin, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(1)], names=schema.names)
                begin += part.num_rows

    return encoded.select("doc_id", "ids").mapInArrow(decoded, schema)
