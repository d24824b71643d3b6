"""Exact top-k inner products by no-random-access aggregation.

A shard keeps one list per dimension, sorted by component. For a query, lists of positive weights are
read from the top and lists of negative weights from the bottom, all to the same depth. What has been
read of a row gives it a lower bound (unread components at their list's far end) and an upper bound
(unread components at the last value read). Reading stops when the rows whose upper bound reaches the
k-th lower bound are few or all lists are read; final scores of these rows are then resolved. No other
row can qualify, ties included.

Components are integers, ``floor(scale * x)``, and all sums are exact: 32-bit floats where no sum can reach
2^24, 64-bit floats below 2^53, else Python integers, kept within the range of a long.

Nulls: rows with a null id, a null vector, or null or non-finite components take no part. Empty vectors score
0; shorter vectors are filled with zeros. Repeated rows are candidates each. A table without queries
or candidates gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields
from .vectors import best_k, finite_vectors, search_cells

SCALE = 256
_HIT = fields(("query_id", "long"), ("vec_id", "long"), ("score", "long"))


class SortedLists:
    """The sorted lists of a shard's rows."""

    def __init__(self, rows: np.ndarray):
        n, d = rows.shape
        self.rows, self.n = rows, n
        order = np.argsort(rows, axis=0, kind="stable")
        self.rank = np.empty((n, d), np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(rows, order, axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (query x row) after reading ``depth`` entries of each list."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        from_top, from_bottom = self.rank >= self.n - depth, self.rank < depth
        parts = np.concatenate([self.rows * from_top, self.rows * from_bottom, ~from_top, ~from_bottom], axis=1, dtype=self.rows.dtype)
        far = np.concatenate([up, down, up * self.sorted[0], down * self.sorted[-1]], axis=1)
        last = np.concatenate([up, down, up * self.sorted[self.n - depth], down * self.sorted[depth - 1]], axis=1)
        return far @ parts.T, last @ parts.T


def exact_cell(k: int, few: int = 64, depths=(0.25, 0.5, 0.75)):
    """The search of one cell; ``depths`` are shares of the lists at which bounds are compared."""

    def scores_of(q: np.ndarray, rows: np.ndarray, limit: float) -> np.ndarray:
        if limit < 2**53:
            return (rows @ q).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in rows]
        return np.array([min(max(x, 1 - 2**63), 2**63 - 1) for x in whole], np.int64)

    def cell(query_ids, queries, ids, rows):
        queries, rows = np.floor(SCALE * queries), np.floor(SCALE * rows)
        top = lambda x: float(np.abs(x).max()) if x.size else 0.0
        limit = top(queries) * top(rows) * max(1, rows.shape[1])
        if limit < 2**24:
            queries, rows = queries.astype(np.float32), rows.astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def resolve(i: int, alive: np.ndarray) -> None:
            score = scores_of(queries[i], rows[alive], limit)
            best = best_k(score, ids[alive], k)
            found.append((np.full(len(best), query_ids[i]), ids[alive][best], score[best]))

        waiting = np.arange(len(queries))
        if rows.shape[1] and limit < 2**53 and len(ids) > few:
            lists = SortedLists(rows)
            for share in depths:
                lower, upper = lists.bounds(queries[waiting], max(1, int(share * lists.n)))
                own = query_ids[waiting][:, None] == ids[None, :]
                lower[own], upper[own] = -np.inf, -np.inf
                kth = np.partition(lower, lists.n - k, axis=1)[:, lists.n - k] if lists.n >= k else np.full(len(waiting), -np.inf)
                alive = (upper >= kth[:, None]) & ~own
                done = alive.sum(axis=1) <= few
                for j in np.flatnonzero(done):
                    resolve(waiting[j], np.flatnonzero(alive[j]))
                waiting = waiting[~done]
                if not len(waiting):
                    break
        # The lists are read to their end: every score is known.
        for at in range(0, len(waiting), 64):
            part = waiting[at : at + 64]
            if limit < 2**53:
                scores = queries[part] @ rows.T
                for i, s in zip(part, scores):
                    other = np.flatnonzero(ids != query_ids[i])
                    best = best_k(s[other], ids[other], k)
                    found.append((np.full(len(best), query_ids[i]), ids[other][best], s[other][best].astype(np.int64)))
            else:
                for i in part:
                    resolve(i, np.flatnonzero(ids != query_ids[i]))
        return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3

    return cell


def top_inner_products(embeddings: DataFrame, k: int = 5, every: int = 50, block: int = 512, shard: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query."""
    return search_cells(finite_vectors(embeddings).where(F.col("vec_id").isNotNull()), every, k, block, shard, exact_cell(k), _HIT)
