"""Document quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. The weights maximise the likelihood that
the better document of each preference pair wins: logistic loss on feature differences. The score
quantile at the share of rejected labels is the threshold; scores are mapped to (0, 1) so that the
threshold lies at a fixed value.

The fit sees at most ``max_labels`` labelled rows of each label (a seeded sample by hash) and
``max_pairs`` pairs; features and scores are made for every document.

Nulls: a null text counts as the empty text, whose features are all zero and which gets a score like any
other; labels that are null or not 0/1, or of unknown documents, are ignored; rows with a null id take no part in
the fit and count as held out. Repeated rows are scored each. Without labels of both kinds every score is 1. An empty table
gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fields, lean, text_bytes

THRESHOLD = 0.3
MAX_LABELS = 8_000
MAX_PAIRS = 60_000

# Byte classes: lower, upper, digit, blank, line feed, sentence marks, brackets and quotes, bar and tab, other marks, the rest.
_CLASSES = 10
_CLASS = np.full(256, _CLASSES - 1, np.uint8)
for _i, _members in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:?", b"()[]{}'\"-/<>", b"|\t", b"!#$%&*+=@\\^_`~")
):
    _CLASS[np.frombuffer(_members, np.uint8)] = _i
_SCALARS = 9
FEATURES = _SCALARS + _CLASSES + _CLASSES * _CLASSES
_LINES = re.compile(rb"[\r\n]+")


def features(text: bytes) -> np.ndarray:
    """Features of one text: shares of byte classes and of their successions, repetition, word lengths."""
    out = np.zeros(FEATURES, np.float32)
    words = text.split()
    if not words:
        return out
    n = len(words)
    codes = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int64)
    size = len(codes)
    lines = [x for x in _LINES.split(text) if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    triples = len(set(zip(words, words[1:], words[2:])))
    out[:_SCALARS] = (
        np.log1p(n) / 10, len(set(words)) / n, pairs / max(1, n - 1), triples / max(1, n - 2), len(set(lines)) / len(lines),
        min(size / n, 40) / 10, np.log1p(n / len(lines)) / 5, max(map(len, words)) > 60, n < 20,
    )
    out[_SCALARS : _SCALARS + _CLASSES] = np.bincount(codes, minlength=_CLASSES) / size
    if size > 1:
        steps = np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=_CLASSES**2)
        out[_SCALARS + _CLASSES :] = np.sqrt(steps / (size - 1))
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features as bytes) of every document."""
    kind = docs.schema["doc_id"].dataType

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [features(t or b"").tobytes() for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(lean(made), fields(("doc_id", kind), ("features", "binary")))


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by checksum of their text; labels of these are never learned."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bradley_terry(better: np.ndarray, worse: np.ndarray, max_pairs: int, seed: int, ridge: float = 1e-3) -> np.ndarray:
    """Weights from pairs (better, worse) drawn with a seed, by Newton steps on the logistic loss."""
    draw = np.random.default_rng(seed)
    n = min(max_pairs, 8 * max(len(better), len(worse)))
    i = np.resize(draw.permutation(len(better)), n)
    j = draw.integers(0, len(worse), n)
    weights = np.zeros(better.shape[1])

    def loss(w: np.ndarray) -> float:
        total = 0.0
        for at in range(0, n, 20_000):
            d = (better[i[at : at + 20_000]] - worse[j[at : at + 20_000]]) @ w
            total += np.logaddexp(0, -d).sum()
        return total / n + ridge / 2 * w @ w

    now = loss(weights)
    for _ in range(25):
        slope, bend = ridge * weights, ridge * np.eye(len(weights))
        for at in range(0, n, 20_000):
            d = better[i[at : at + 20_000]] - worse[j[at : at + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ weights, -50, 50)))  # chance that the worse one wins
            slope = slope - d.T @ p / n
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d / n
        step = np.linalg.solve(bend, slope)
        rate = 1.0
        while rate > 1e-3 and loss(weights - rate * step) > now:
            rate /= 2
        weights, before, now = weights - rate * step, now, loss(weights - rate * step)
        if before - now < 1e-7:
            break
    return weights


def fit(
    featured: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_pairs: int = MAX_PAIRS, seed: int = 11, threshold: float = THRESHOLD
) -> tuple[np.ndarray, float, float] | None:
    """(weights, slope, offset): the score of features x is ``1 / (1 + exp(-(slope * x.w + offset)))``."""
    label = F.col("quality")
    usable = (
        labels.select("doc_id", "quality").where(label.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    )
    # Two bounded samples, each the smallest hashes of its label.
    chosen = usable.where(label == 0).orderBy("_h", "doc_id").limit(max_labels).unionByName(
        usable.where(label == 1).orderBy("_h", "doc_id").limit(max_labels)
    )
    counts = {int(r[0]): r[1] for r in usable.groupBy("quality").count().collect()}
    rows = featured.join(F.broadcast(chosen.select("doc_id", "quality").distinct()), "doc_id").select("quality", "features", "doc_id")
    # A document repeated many times still counts as one row of the sample.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).orderBy("doc_id", "quality").collect()
    if len({r["quality"] for r in rows}) < 2:
        return None
    x = np.array([np.frombuffer(r["features"], np.float32) for r in rows], np.float64)
    y = np.array([r["quality"] for r in rows])
    weights = bradley_terry(x[y == 1], x[y == 0], max_pairs, seed)
    scores = x @ weights
    # Each label stands for its share of all labelled rows, not of the sample.
    mass = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    order = np.argsort(scores, kind="stable")
    at = int(np.searchsorted(np.cumsum(mass[order]), counts[0]))
    cut = (scores[order[min(at, len(order) - 1)]] + scores[order[min(at + 1, len(order) - 1)]]) / 2
    z = scores - cut
    offset = float(np.log(threshold / (1 - threshold)))
    slopes = np.geomspace(0.05, 20, 60)
    fits = [(mass * np.logaddexp(0, np.where(y == 1, -1, 1) * (s * z + offset))).sum() for s in slopes]
    slope = float(slopes[int(np.argmin(fits))])
    return weights, slope, offset - slope * float(cut)


def score(featured: DataFrame, model: tuple[np.ndarray, float, float] | None) -> DataFrame:
    """(doc_id, score) of every featured row."""
    schema = fields(("doc_id", featured.schema["doc_id"].dataType), ("score", "double"))

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if model is None:
                out = np.ones(batch.num_rows)
            else:
                weights, slope, offset = model
                x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
                out = 1 / (1 + np.exp(-np.clip(slope * (x.astype(np.float64) @ weights) + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return featured.select("doc_id", "features").mapInArrow(scored, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Score every document: (doc_id, held_out, score, predicted)."""
    featured = Scratch(docs.sparkSession).store(with_features(docs), "features")
    model = fit(featured, labels, threshold=threshold, **options)
    rows = score(featured, model)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns.

    Texts are read a second time and scored where they are, so that no text is shuffled.
    """
    featured = Scratch(docs.sparkSession).store(with_features(docs), "features")
    model = fit(featured, labels, threshold=threshold, **options)
    names = docs.columns

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if model is None:
                yield batch
                continue
            weights, slope, offset = model
            texts = text_bytes(batch.column(names.index("text")))
            x = np.array([features(t or b"") for t in texts], np.float64).reshape(-1, FEATURES)
            value = 1 / (1 + np.exp(-np.clip(slope * (x @ weights) + offset, -500, 500)))
            yield batch.filter(pa.array(value >= threshold))

    return docs.mapInArrow(lean(kept), docs.schema)
