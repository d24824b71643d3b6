"""Repeated passages by compaction of a sparse De Bruijn graph of words.

A passage is a window of ``window`` consecutive words. Runs of k words are edges between their neighbours
in a text; of the runs in each window only the one with the least hash is an edge, so equal windows have
the same edge at the same place and about a tenth of the runs is enough.

1. Edges of all texts meet by hash; those at two or more places stay, with their coordinates.
2. An edge with one successor at one distance whose successor has it as the only predecessor is a
   nonbranching link. Spark joins carry that back to the coordinates; chains of links are compacted to
   paths. All places of a path hold the same words, so its windows are repeated.
3. Windows around branches and path ends, whose edge is repeated, are verified at their source
   coordinates: their hashes meet, and those at two or more places are repeated.

Texts that occur more than once are worked on once; all their windows are repeated. Words and windows are
compared by 64-bit hashes. Blobs of coordinates are shuffled rather than rows; a frequent passage adds
some bytes per place, no pairs are made.

Nulls: a null text has no words; null ids are kept. Empty and short texts lose nothing. Repeated rows
are copies of a text. An empty table gives an empty result. Other columns of the input are ignored by
``repeated_words`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, broadcast_checked, fields, gram_hashes, lean, set_apart, text_bytes, word_hashes

WINDOW = 35
BUCKET_ENTRIES = 400_000
_HELD = 500_000
_EDGE = np.dtype([("e", "<u8"), ("t", "<i8"), ("p", "<u4"), ("o", "<u4")])
_PLACE = np.dtype([("e", "<u8"), ("t", "<i8"), ("p", "<u4")])
_SPAN = np.dtype([("t", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
_BLOB = fields(("bucket", "int"), ("kind", "int"), ("body", "binary"))


def window_edges(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, and for each window the place of its edge."""
    k = window // 2 + 1
    runs = gram_hashes(words, k)
    n = len(words) - window + 1
    if n <= 0:
        return runs, np.empty(0, np.int64)
    width = window - k + 1
    return runs, np.arange(n) + np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1)


def _blobs(buckets: np.ndarray, kind: int, rows: np.ndarray):
    """One blob for each bucket that has rows."""
    import pyarrow as pa

    order = np.argsort(buckets, kind="stable")
    buckets, rows = buckets[order], rows[order]
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.empty(0, np.int64)
    bodies = [rows[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(rows)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[first], pa.int32()), pa.array([kind] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())], names=_BLOB.names
    )


def _rows_of(table, kind: int, dtype: np.dtype) -> np.ndarray:
    bodies = [b for k, b in zip(table.column("kind").to_pylist(), table.column("body").to_pylist()) if k == kind]
    return np.frombuffer(b"".join(bodies), dtype)


def _repeated(rows: np.ndarray) -> np.ndarray:
    """The distinct rows whose hash ``e`` stands at two or more places, sorted by hash."""
    rows = rows[np.lexsort((rows["p"], rows["t"], rows["e"]))]
    if len(rows) < 2:
        return rows[:0]
    same = rows["e"][1:] == rows["e"][:-1]
    again = same & (rows["t"][1:] == rows["t"][:-1]) & (rows["p"][1:] == rows["p"][:-1])
    rows = rows[np.r_[True, ~again]]
    same = rows["e"][1:] == rows["e"][:-1]
    return rows[np.r_[same, False] | np.r_[False, same]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("t"), "text").where("text is not null")


def _edge_blobs(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    def made(batches: Iterator) -> Iterator:
        seen: set[int] = set()
        for batch in batches:
            parts = []
            for t, text in zip(batch.column("t").to_pylist(), text_bytes(batch.column("text"))):
                words = text.split()
                if len(words) < window or t in seen:
                    continue
                seen.add(t)
                runs, at = window_edges(word_hashes(words), window)
                at = at[np.r_[True, at[1:] != at[:-1]]]
                rows = np.empty(len(at), _EDGE)
                rows["e"], rows["t"], rows["p"], rows["o"] = runs[at], t, at, np.arange(len(at))
                parts.append(rows)
                if sum(map(len, parts)) > _HELD:
                    rows = np.concatenate(parts)
                    parts = []
                    yield _blobs((rows["e"] % np.uint64(buckets)).astype(np.int64), 0, rows)
            rows = np.concatenate(parts) if parts else np.empty(0, _EDGE)
            yield _blobs((rows["e"] % np.uint64(buckets)).astype(np.int64), 0, rows)

    return texts.mapInArrow(lean(made), _BLOB)


def _repeated_edges(blobs: DataFrame) -> DataFrame:
    """(t, o, p, e): coordinates of the edges at two or more places; ``o`` counts a text's edges."""
    schema = fields(("t", "long"), ("o", "long"), ("p", "long"), ("e", "long"))

    def kept(table):
        import pyarrow as pa

        rows = _repeated(_rows_of(table, 0, _EDGE))
        columns = (rows["t"], rows["o"].astype(np.int64), rows["p"].astype(np.int64), np.ascontiguousarray(rows["e"]).view("<i8"))
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=schema.names)

    return blobs.groupBy("bucket").applyInArrow(kept, schema)


def _linked(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, chain): a text's repeated edges in order, each with whether its neighbours are always the same.

    The flags are stored before they are joined, so that adaptive execution can split a hot edge.
    """
    order = Window.partitionBy("t").orderBy("o")
    beside = lambda f, step: F.when(
        f("o").over(order) == F.col("o") + step, F.struct(f("e").over(order).alias("e"), (f("p").over(order) - F.col("p")).alias("d"))
    ).otherwise(F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("d")))
    rows = edges.select("t", "o", "p", "e", beside(F.lead, 1).alias("after"), beside(F.lag, -1).alias("before"))
    single = rows.groupBy("e").agg(
        ((F.min("after") == F.max("after")) & (F.min("after.d") != 0)).alias("one_after"),
        ((F.min("before") == F.max("before")) & (F.min("before.d") != 0)).alias("one_before"),
    )
    flags = rows.select("t", "o", "p", "e").join(scratch.store(single, "single"), "e")
    return flags.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("o", "p", "one_after", "one_before"))).alias("chain"))


def _path_windows(chain: list[dict], window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` windows whether it lies in a path; for each place whether an edge is repeated."""
    k = window // 2 + 1
    o, p = np.array([x["o"] for x in chain]), np.array([x["p"] for x in chain])
    after, before = np.array([x["one_after"] for x in chain]), np.array([x["one_before"] for x in chain])
    edge = np.zeros(n + window, bool)
    edge[p] = True
    breaks = np.flatnonzero(~(after[:-1] & before[1:] & (o[1:] == o[:-1] + 1)))
    first, last = p[np.r_[0, breaks + 1]], p[np.r_[breaks, len(p) - 1]]
    inside = np.zeros(n + 1, np.int64)
    long = last + k - window >= first
    np.add.at(inside, first[long], 1)
    np.add.at(inside, np.minimum(last[long] + k - window + 1, n), -1)
    return np.cumsum(inside)[:n] > 0, edge


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return steps[::2], steps[1::2]


def _window_blobs(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Kind 0: places of windows to verify, by hash; kind 1: spans of windows known as repeated, by text."""

    def made(batches: Iterator) -> Iterator:
        seen: set[int] = set()
        for batch in batches:
            places, spans = [], []
            for t, text, chain in zip(batch.column("t").to_pylist(), text_bytes(batch.column("text")), batch.column("chain").to_pylist()):
                if t in seen:
                    continue
                seen.add(t)
                words = word_hashes(text.split())
                _, at = window_edges(words, window)
                inside, edge = _path_windows(chain, window, len(at))
                open_windows = np.flatnonzero(edge[at] & ~inside)
                part = np.empty(len(open_windows), _PLACE)
                part["e"], part["t"], part["p"] = gram_hashes(words, window)[open_windows], t, open_windows
                places.append(part)
                lo, hi = _spans(inside)
                span = np.empty(len(lo), _SPAN)
                span["t"], span["lo"], span["hi"] = t, lo, hi
                spans.append(span)
                if sum(map(len, places)) > _HELD:
                    rows = np.concatenate(places)
                    places = []
                    yield _blobs((rows["e"] % np.uint64(buckets)).astype(np.int64), 0, rows)
            rows = np.concatenate(places) if places else np.empty(0, _PLACE)
            yield _blobs((rows["e"] % np.uint64(buckets)).astype(np.int64), 0, rows)
            rows = np.concatenate(spans) if spans else np.empty(0, _SPAN)
            yield _blobs(np.mod(rows["t"], buckets), 1, rows)

    return rows.mapInArrow(lean(made), _BLOB)


def _verified(blobs: DataFrame, buckets: int) -> DataFrame:
    """Spans of repeated windows, in blobs by text."""

    def kept(table):
        import pyarrow as pa

        rows = _repeated(_rows_of(table, 0, _PLACE))
        rows = rows[np.lexsort((rows["p"], rows["t"]))]
        known = _rows_of(table, 1, _SPAN)
        start = np.r_[True, (rows["t"][1:] != rows["t"][:-1]) | (rows["p"][1:] != rows["p"][:-1] + 1)] if len(rows) else np.empty(0, bool)
        first = np.flatnonzero(start)
        spans = np.empty(len(first), _SPAN)
        spans["t"], spans["lo"] = rows["t"][first], rows["p"][first]
        spans["hi"] = rows["p"][np.r_[first[1:], len(rows)] - 1] + 1 if len(first) else 0
        spans = np.concatenate([spans, known])
        return pa.Table.from_batches([_blobs(np.mod(spans["t"], buckets), 1, spans)])

    return blobs.groupBy("bucket").applyInArrow(kept, _BLOB)


def _removed_spans(blobs: DataFrame, window: int) -> DataFrame:
    """(t, spans): word spans of each text that repeated windows cover, as pairs of 32-bit integers."""
    schema = fields(("t", "long"), ("spans", "binary"))

    def merged(table):
        import pyarrow as pa

        rows = _rows_of(table, 1, _SPAN)
        rows = rows[np.lexsort((rows["lo"], rows["t"]))]
        first = np.flatnonzero(np.r_[True, rows["t"][1:] != rows["t"][:-1]]) if len(rows) else np.empty(0, np.int64)
        texts, bodies = [], []
        for a, b in zip(first, np.r_[first[1:], len(rows)]):
            lo, hi = rows["lo"][a:b].astype(np.int64), np.maximum.accumulate(rows["hi"][a:b].astype(np.int64) + window - 1)
            new = np.r_[True, lo[1:] > hi[:-1]]
            begin = np.flatnonzero(new)
            texts.append(int(rows["t"][a]))
            bodies.append(np.stack([lo[begin], hi[np.r_[begin[1:], len(lo)] - 1]], axis=1).astype("<u4").tobytes())
        return pa.Table.from_arrays([pa.array(texts, pa.int64()), pa.array(bodies, pa.binary())], names=schema.names)

    return blobs.groupBy("bucket").applyInArrow(merged, schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """(t, copied, spans) of the texts with repeated windows; ``t`` is the text's hash, ``copied`` says that
    the text occurs more than once."""
    scratch = scratch or Scratch(docs.sparkSession)
    texts = _texts(docs)
    chars = docs.select(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    # Some six bytes a word, and an edge every ten words.
    buckets = max(64, int(chars) // 57 // BUCKET_ENTRIES)
    edges = scratch.store(_repeated_edges(_edge_blobs(texts, window, buckets)), "edges")
    chains = broadcast_checked(scratch.store(_linked(edges, scratch), "chains"))
    blobs = _verified(_window_blobs(texts.join(chains, "t"), window, buckets), buckets)
    spans = _removed_spans(blobs, window)
    copied = texts.groupBy("t").count().where("count > 1").select("t", F.lit(True).alias("copied"))
    marks = scratch.store(spans.join(copied, "t", "full"), "spans")
    scratch.drop("edges")
    return marks


def kept_mask(n: int, spans: bytes | None, copied: bool, window: int) -> np.ndarray:
    """Which of ``n`` words stay."""
    if copied and n >= window:
        return np.zeros(n, bool)
    keep = np.ones(n, bool)
    for lo, hi in np.frombuffer(spans or b"", "<u4").reshape(-1, 2).tolist():
        keep[lo:hi] = False
    return keep


def _marked(docs: DataFrame, window: int) -> DataFrame:
    marks = broadcast_checked(repeated_spans(docs, window))
    marks = marks.select(F.col("t").alias("_t"), F.col("copied").alias("_copied"), F.col("spans").alias("_spans"))
    return docs.withColumn("_t0", F.xxhash64("text")).join(marks, F.col("_t0") == F.col("_t"), "left").drop("_t", "_t0")


def _left(text: bytes | None, copied, spans, window: int) -> tuple[list[bytes], int]:
    words = (text or b"").split()
    keep = kept_mask(len(words), spans, bool(copied), window)
    return (words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]), len(words)


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    kind = docs.schema["doc_id"].dataType
    schema = fields(("doc_id", kind), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, copied, spans in zip(text_bytes(batch.column("text")), batch.column("_copied").to_pylist(), batch.column("_spans").to_pylist()):
                kept, n = _left(text, copied, spans, window)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=schema.names,
            )

    return _marked(docs.select("doc_id", "text"), window).mapInArrow(lean(counted), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words of repeated passages. Texts that lose nothing stay as they are, others are
    their kept words joined by one space; rows that lose all their words are dropped."""
    docs, restore = set_apart(docs, ("doc_id", "text", "n_chars"))
    names, schema = docs.columns, StructType(docs.schema.fields)

    def kept_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, stay = [], []
            for text, copied, spans in zip(text_bytes(batch.column("text")), batch.column("_copied").to_pylist(), batch.column("_spans").to_pylist()):
                kept, n = _left(text, copied, spans, window)
                stay.append(bool(kept) or not n)
                texts.append(None if text is None else (text if len(kept) == n else b" ".join(kept)).decode("utf-8", "replace"))
            columns = []
            for name in names:
                column = batch.column(name)
                if name == "text":
                    column = pa.array(texts, column.type)
                elif name == "n_chars":
                    column = pa.array([None if t is None else len(t) for t in texts], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return restore(_marked(docs, window).mapInArrow(lean(kept_rows), schema))
