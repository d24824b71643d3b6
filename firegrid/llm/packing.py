"""Packing token sequences: best fit, then a swap-based local search.

Every task tokenizes whole texts; only lengths and checksums are shuffled. Pieces are dealt to packing
groups of bounded size by hash, each group is packed by itself, and a group leaves at most about one
sequence underfull, so many groups cost little. The search has no bounds of its own: it looks at all
underfull sequences of a group and ends when none of them can exchange anything.

Nulls: a null text is the empty text, which still has the closing id; a null id is kept. Very long
texts are cut into full pieces. Ties are broken by order in the group, which is sorted, so reruns
agree. Repeated rows are packed each. An empty table gives an empty result. Other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fields, lean

CAPACITY = 4096
GROUP_PIECES = 50_000
# A word of Latin letters (none of which changes its length in lower case) and marks that the tokenizer takes as
# one run behind it.
_WORD = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<marks>[.,;:!?*&%$#|\"]*)$"
_LEARNED_WORDS = 20_000
_GATHERED_CHUNKS = 250_000


class Ragged:
    """Runs of ids, one after the other in ``flat``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, which: np.ndarray) -> Ragged:
        sizes = self.sizes[which]
        shift = self.starts[which] - (np.cumsum(sizes) - sizes)
        return Ragged(self.flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)], sizes)


class ChunkIds:
    """Ids of chunks between ASCII white space.

    The tokenizer drops white space, looks at letters in lower case and never across white space or from
    letters to marks. So a text's ids are those of its chunks in order, and those of a word with
    marks behind it are the word's and the marks'. Words are encoded together, each ends with the only
    token that closes a word; any other chunk is encoded by itself. Nothing is remembered but the tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # Words come in lower case and composed, which is all that the normalizer would see to.
        self.normal = Tokenizer(self.tokenizer.model)
        self.normal.pre_tokenizer = self.tokenizer.pre_tokenizer

    def _encode(self, text: str, normal: bool = False) -> np.ndarray:
        tokenizer = self.normal if normal else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _words(self, words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and their numbers of an Arrow array of words of letters."""
        for at in range(0, len(words), _LEARNED_WORDS):
            part = words.slice(at, _LEARNED_WORDS).to_pylist()
            ids = self._encode(" ".join(part), normal=True)
            sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(sizes) != len(part) or sizes.sum() != len(ids):
                raise ValueError("a word of letters is not one word to this tokenizer")
            yield ids, sizes

    def chunk_ids(self, chunks) -> Ragged:
        """Ids of an Arrow array of distinct chunks."""
        import pyarrow.compute as pc

        split = pc.extract_regex(chunks, _WORD)
        plain = pc.is_valid(split)
        words = pc.utf8_lower(pc.struct_field(split.filter(plain), "word")).dictionary_encode()
        marks = pc.struct_field(split.filter(plain), "marks").dictionary_encode()
        odd = chunks.filter(pc.invert(plain)).cast("binary").to_pylist()
        others = [self._encode(m) for m in marks.dictionary.to_pylist()] + [self._encode(c.decode("utf-8", "replace")) for c in odd]
        runs = list(self._words(words.dictionary)) + [(ids, np.array([len(ids)])) for ids in [*others, np.empty(0, "<u4")]]
        parts = Ragged(np.concatenate([ids for ids, _ in runs]), np.concatenate([sizes for _, sizes in runs]))
        # A chunk is two parts: a word and its marks, or an odd chunk and nothing, the last part.
        plain = plain.to_numpy(zero_copy_only=False)
        n_words, n_marks = len(words.dictionary), len(marks.dictionary)
        pairs = np.full((len(chunks), 2), len(parts.sizes) - 1)
        pairs[plain, 0] = words.indices.to_numpy()
        pairs[plain, 1] = marks.indices.to_numpy() + n_words
        pairs[~plain, 0] = np.arange(len(odd)) + n_words + n_marks
        both = parts.take(pairs.ravel())
        return Ragged(both.flat, both.sizes.reshape(-1, 2).sum(axis=1))


@lru_cache(maxsize=1)
def _chunk_ids(tokenizer_path: str) -> ChunkIds:
    return ChunkIds(tokenizer_path)


def _ids(chunk_ids: ChunkIds, texts, closing_id: int) -> Iterator[np.ndarray]:
    """Ids of each text of an Arrow array."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    del split
    known = chunk_ids.chunk_ids(coded.dictionary)
    known = Ragged(np.append(known.flat, np.array([closing_id], "<u4")), np.append(known.sizes, 1))
    closing, which = len(known.sizes) - 1, coded.indices.to_numpy()
    first = begin = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, begin + _GATHERED_CHUNKS, "right")))
        own = ends[first:last] - begin
        found = known.take(np.insert(which[begin : ends[last - 1]], own, closing))
        after = np.cumsum(found.sizes)[own + np.arange(len(own))]
        yield from np.split(found.flat, after[:-1])
        first, begin = last, int(ends[last - 1])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids, cut only where too long."""
    kind = docs.schema["doc_id"].dataType
    schema = fields(("doc_id", kind), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chunk_ids = _chunk_ids(tokenizer_path)
        for batch in batches:
            source, rows = [], []
            for i, ids in enumerate(_ids(chunk_ids, batch.column("text"), closing_id)):
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    source.append(i)
                    rows.append((p, at, len(part), zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(columns[0], pa.int32())]
                + [pa.array(c, pa.int64()) for c in columns[1:]],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(lean(pieces), schema)


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> list[list[int]]:
    """Best fit in the order of arrival, or in ``order``: each item goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit f is set if some bin has f free
    sizes = lengths.tolist()
    for item in range(len(sizes)) if order is None else order.tolist():
        size = sizes[item]
        fits = present >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                present ^= 1 << free
            bins[at].append(item)
        else:
            free, at = capacity, len(bins)
            bins.append([item])
        free -= size
        by_free[free].append(at)
        present |= 1 << free
    return bins


class _Widest:
    """For each key, the bin with the most free space that is filed under it; changed bins drop out lazily."""

    def __init__(self, keys: int, version: list[int]):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(keys)]
        self.free = np.zeros(keys, np.int64)
        self.version = version

    def file(self, key: int, free: int, at: int) -> None:
        heappush(self.heaps[key], (-free, at, self.version[at]))
        if free > self.free[key]:
            self.free[key] = free

    def refresh(self, key: int) -> None:
        heap = self.heaps[key]
        while heap and heap[0][2] != self.version[heap[0][1]]:
            heappop(heap)
        self.free[key] = -heap[0][0] if heap else 0


class SwapSearch:
    """Empty bins by exchanges that raise the sum of squared fills.

    The emptiest bin gives to fuller ones: a document moves, or one document or two go for a smaller one. Underfull
    bins are filed by the size of each document they could give back (0: none) and by that size plus their free space,
    so that one look over the sizes finds the best exchange with any bin: one that fills the other bin to the brim,
    else the one that moves most. A giver that can exchange nothing is set aside and the next one gives; givers come
    again until none of them could exchange anything, or until the lower bound of bins is reached.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.capacity, self.sizes = bins, capacity, lengths.tolist()
        self.fill = [sum(map(self.sizes.__getitem__, b)) for b in bins]
        self.version = [0] * len(bins)
        self.by_size, self.by_reach = _Widest(capacity + 1, self.version), _Widest(capacity + 1, self.version)
        self.exchanges = 0

    def _file(self, at: int) -> None:
        free = self.capacity - self.fill[at]
        for size in {0, *map(self.sizes.__getitem__, self.bins[at])} if free else ():
            self.by_size.file(size, free, at)
            self.by_reach.file(size + free, free, at)

    def _withdraw(self, at: int) -> None:
        self.version[at] += 1
        free = self.capacity - self.fill[at]
        for size in {0, *map(self.sizes.__getitem__, self.bins[at])} if free else ():
            self.by_size.refresh(size)
            self.by_reach.refresh(size + free)

    def _offers(self, giver: int) -> np.ndarray:
        """The sizes of one and of two documents of a bin."""
        one, n = np.unique([self.sizes[i] for i in self.bins[giver]], return_counts=True)
        first, second = np.triu_indices(len(one))
        two = (one[first] + one[second])[(first != second) | (n[first] > 1)]
        return np.unique(np.concatenate([one, two]))

    def _best(self, offers: np.ndarray) -> tuple[int, int, int] | None:
        """(size given, size got back, taker)"""
        brim = self.by_reach.free[offers]
        k = int(brim.argmax())
        if brim[k] > 0:
            size, got = int(offers[k]), int(offers[k] - brim[k])
            return size, got, self.by_reach.heaps[size][0][1]
        reach = np.where(self.by_size.free > 0, np.arange(self.capacity + 1) + self.by_size.free, 0)
        got = np.searchsorted(np.maximum.accumulate(reach), offers)
        moved = np.where(got <= self.capacity, offers - got, 0)
        k = int(moved.argmax())
        if moved[k] <= 0:
            return None
        return int(offers[k]), int(got[k]), self.by_size.heaps[int(got[k])][0][1]

    def _documents(self, at: int, size: int) -> list[int]:
        """One document of a bin, else two, of a size together."""
        by_size: dict[int, int] = {}
        for i in self.bins[at]:
            if self.sizes[i] == size:
                return [i]
        for i in self.bins[at]:
            if (other := by_size.get(size - self.sizes[i])) is not None:
                return [other, i]
            by_size[self.sizes[i]] = i
        raise AssertionError(size)

    def _give(self, giver: int) -> bool:
        """Exchange as long as something fits; whether anything did. The giver stays withdrawn."""
        self._withdraw(giver)
        changed = False
        while self.bins[giver] and (found := self._best(self._offers(giver))) is not None:
            size, got, taker = found
            self._withdraw(taker)
            out = self._documents(giver, size)
            back = self._documents(taker, got) if got else []
            self.bins[giver] = [i for i in self.bins[giver] if i not in out] + back
            self.bins[taker] = [i for i in self.bins[taker] if i not in back] + out
            self.fill[giver] -= size - got
            self.fill[taker] += size - got
            self._file(taker)
            self.exchanges += 1
            changed = True
        return changed

    def run(self) -> list[list[int]]:
        alive, least = sum(map(bool, self.bins)), -(-sum(self.fill) // self.capacity)
        changed = True
        while changed and alive > least:
            changed = False
            waiting = [at for at, fill in enumerate(self.fill) if 0 < fill < self.capacity]
            for at in waiting:
                self._file(at)
            givers = [(self.fill[at], at) for at in waiting]
            heapify(givers)
            while givers and alive > least:
                fill, giver = heappop(givers)
                if fill != self.fill[giver]:  # it has taken something
                    if self.fill[giver] < self.capacity:
                        heappush(givers, (self.fill[giver], giver))
                    continue
                changed |= self._give(giver)
                alive -= not self.bins[giver]
            for at in waiting:
                self._withdraw(at)
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """``bins`` after a :class:`SwapSearch`, without those that it emptied."""
    return SwapSearch(bins, lengths, capacity).run()


def fewest_bins(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in falling order and the search behind it, which ends at once at the lower bound of bins."""
    return local_search(best_fit(lengths, capacity, np.argsort(-lengths, kind="stable")), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with a ``length`` column."""
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    schema = fields(*[(f.name, f.dataType) for f in pieces.schema], ("sequence_id", "long"), ("offset", "long"))
    order = pieces.columns

    def packed(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="_group").sort_values(order, kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins = fewest_bins(lengths, capacity)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for i, items in enumerate(bins):
            sequence[items] = (int(key[0]) << 32) + i
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        frame["sequence_id"], frame["offset"] = sequence, offset
        return frame[schema.names]

    # The second key deals repeated rows to different groups, so that no group outgrows its bound.
    spread = F.xxhash64(*order, F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    grouped = pieces.withColumn("_group", F.pmod(spread, F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(packed, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = 1, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece with its sequence and place in it."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.store(token_pieces(docs, tokenizer_path, capacity, closing_id), "pieces")
    return pack(pieces, capacity, group_pieces)
