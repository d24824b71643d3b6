"""Embedding whitening by polarisation covariance.

Components are integers, ``x = floor(scale * c) + offset``. No product of two dimensions is ever formed: the
covariance of dimensions a and b is half of what the variance of their sum exceeds the variances of both,
``2 cov(a, b) = var(a + b) - var(a) - var(b)``. Spark aggregates the squares of every centred dimension and of
every sum of two; the driver gets d (d + 1) / 2 integers, assembles the matrix and takes its eigenvectors.

All sums are exact. Values are centred at the integer next to their mean before they are squared, so the
offset never enters a product; the rest of the mean, below one half, is taken off the sums in exact
integers. Partial sums that could leave 64 bits are split in two before they are added.

Nulls: rows whose vector is null or has null or non-finite entries take no part; a null id is kept. Shorter
vectors, empty ones too, are filled with zero entries. Entries count as at most 2^40 in size. Ties: equal
eigenvalues have any orthonormal eigenvectors, the same for all rows; the entry of largest size of each is
positive. Components without variance have a null ``whitened`` and explain 0. Repeated rows count each. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, limit_batches
from .vectors import finite_vectors, matrix

SCALE = 64
OFFSET = 1_000_000
_LIMIT = float(2**40)
_ROWS = 4096
_LONG = 2**63 - 1


def whole_components(column, width: int, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """Integer components of an Arrow column of vectors, ``width`` of them a row."""
    rows = matrix(column)
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    return np.floor(np.clip(rows * scale, -_LIMIT, _LIMIT)).astype(np.int64) + offset


def _parts(batches: Iterator, width: int, scale: int, offset: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield whole_components(batch.column("vector").slice(at, _ROWS), width, scale, offset)


def _exact_sums(batches: Iterator, measure, width: int, scale: int, offset: int) -> Iterator:
    """One row per measured column: the exact sum over a task's rows, as its low 31 bits and the rest."""
    import pyarrow as pa

    totals: list[int] | None = None
    for x in _parts(batches, width, scale, offset):
        sums = measure(x)
        totals = sums if totals is None else [a + b for a, b in zip(totals, sums)]
    if totals:
        high, low = [t >> 31 for t in totals], [t & (2**31 - 1) for t in totals]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(totals)), pa.int32()), pa.array([str(h) for h in high]), pa.array(low, pa.int64())], names=["place", "high", "low"]
        )


def _sums_in_spark(vectors: DataFrame, measure, width: int, scale: int, offset: int) -> list[int]:
    """The exact sums over all rows; as many integers reach the driver as columns are measured."""
    schema = fields(("place", "int"), ("high", "string"), ("low", "long"))
    task = partial(_exact_sums, measure=measure, width=width, scale=scale, offset=offset)
    rows = vectors.select("vector").mapInArrow(task, schema)
    total = rows.groupBy("place").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low"))
    found = {r["place"]: int(r["high"]) * 2**31 + r["low"] for r in total.collect()}
    return [found[i] for i in range(len(found))]


def column_sums(x: np.ndarray) -> list[int]:
    """The number of rows and the sum of every column; 4,096 rows of 2^41 stay within 64 bits."""
    return [len(x), *map(int, x.sum(axis=0))]


def polarised_sums(x: np.ndarray, centre: np.ndarray) -> list[int]:
    """Sums of squares of every centred column, then of the sum of every two columns, pair by pair."""
    y = x - centre
    d = y.shape[1]
    top = int(np.abs(y).max(initial=0))
    if 4 * top * top * len(y) >= _LONG:
        y = y.astype(object)
    sums = [int(s) for s in (y * y).sum(axis=0)]
    for a in range(d - 1):
        both = y[:, a + 1 :] + y[:, a : a + 1]
        if both.dtype == object:
            sums += [int(s) for s in (both * both).sum(axis=0)]
        else:
            sums += np.einsum("ij,ij->j", both, both).tolist()
    return sums


def variances_to_covariance(n: int, sums: list[int], squares: list[int], centre: list[int]) -> tuple[np.ndarray, list[list[int]]]:
    """The covariance, and the same times 2 n^2 in exact integers, from polarised sums.

    With y = x - m, n^2 var(y) = n sum(y^2) - sum(y)^2; the second term takes off the rest of the mean.
    """
    d = len(centre)
    rest = [s - n * m for s, m in zip(sums, centre)]
    alone = [n * squares[a] - rest[a] ** 2 for a in range(d)]
    exact = [[0] * d for _ in range(d)]
    place = d
    for a in range(d):
        exact[a][a] = 2 * alone[a]
        for b in range(a + 1, d):
            both = n * squares[place] - (rest[a] + rest[b]) ** 2
            exact[a][b] = exact[b][a] = both - alone[a] - alone[b]
            place += 1
    covariance = np.array([[v / (2 * n * n) for v in row] for row in exact], np.float64).reshape(d, d)
    return covariance, exact


@dataclass
class Whitening:
    """A fitted whitening: what rows are centred and projected with."""

    n: int
    width: int
    sums: list[int]
    centre: np.ndarray
    components: np.ndarray  # one column per component, over the square root of its eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray
    scale: int = SCALE
    offset: int = OFFSET

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.centre)])
        return ((x - self.centre) - rest) @ self.components

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        y = x - self.centre
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.centre)]
        top = self.n * int(np.abs(y).max(initial=0)) + self.n
        if top * top * max(1, self.width) < _LONG:
            z = y * self.n - np.array(rest, np.int64)
            return (z * z).sum(axis=1).tolist()
        # (n y - r)^2 = n^2 y^2 - 2 n y r + r^2
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]


def fit(embeddings: DataFrame, components: int, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Fit over all rows that take part; None without any."""
    limit_batches(embeddings.sparkSession)
    vectors = finite_vectors(embeddings)
    width = vectors.agg(F.max(F.size("vector")).alias("w")).first()["w"]
    if width is None:
        return None
    n, *sums = _sums_in_spark(vectors, column_sums, width, scale, offset)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squares = _sums_in_spark(vectors, partial(polarised_sums, centre=np.array(centre, np.int64)), width, scale, offset)
    covariance, _ = variances_to_covariance(n, sums, squares, centre)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0) if width else axes
    trace = float(np.trace(covariance))
    real = values > 1e-12 * max(trace, 0.0)
    values = np.where(real, values, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(real, axes / np.sqrt(values), np.nan)
    return Whitening(n, width, sums, np.array(centre, np.int64), scaled, values, values / trace if trace > 0 else values, scale, offset)


def moments(x: np.ndarray, fitted: Whitening) -> list[int]:
    """Sums of the whitened components and of their products, in units of 2^-40."""
    w = np.nan_to_num(fitted.project(x))
    both = w.T @ w
    return [round(v * 2.0**40) for v in [*w.sum(axis=0), *both[np.triu_indices(len(both))]]]


def identity_error(embeddings: DataFrame, fitted: Whitening) -> float:
    """Largest entry, by size, of the whitened rows' covariance minus the identity, over all rows."""
    k = len(fitted.eigenvalues)
    vectors = finite_vectors(embeddings)
    sums = _sums_in_spark(vectors, partial(moments, fitted=fitted), fitted.width, fitted.scale, fitted.offset)
    means = np.array(sums[:k], np.float64) / 2.0**40 / fitted.n
    covariance = np.zeros((k, k))
    covariance[np.triu_indices(k)] = np.array([s / fitted.n for s in sums[k:]]) / 2.0**40
    covariance -= np.triu(np.outer(means, means)) + np.diag((fitted.eigenvalues > 0).astype(float))
    return float(np.abs(covariance).max(initial=0.0))


def whitened_vectors(embeddings: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): one row per vector; ``deviation`` as exact digits."""
    limit_batches(embeddings.sparkSession)
    vectors = finite_vectors(embeddings)

    def projected(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = whole_components(part.column("vector"), fitted.width, fitted.scale, fitted.offset)
                w = fitted.project(x)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                digits = pa.array([str(v) for v in fitted.deviations(x)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), digits, lists], names=["vec_id", "deviation", "whitened"])

    out = vectors.mapInArrow(projected, "vec_id long, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(embeddings: DataFrame, components: int = 32, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(embeddings, components, scale, offset)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(embeddings, fitted)
    shares = F.array(*[F.lit(float(v)) for v in fitted.explained])
    rows = whitened_vectors(embeddings, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("_place") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("_place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
