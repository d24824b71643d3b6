"""Approximate nearest neighbours by collision counting over query-centred windows.

Unit vectors are projected on ``projections`` random directions; a shard keeps one sorted array per
direction. A window of half-width ``radius`` around the query's own projection is found in every array,
and a row whose projections fall into at least ``threshold`` of the windows is verified by its exact cosine.
Radii grow by ``growth`` over the same arrays (virtual rehashing). A query stops when its k-th verified
row lies within the radius, for any nearer row would have collided often enough with high
probability; the last radius covers the unit sphere, so all rows collide. No bucket has a bound.

Nulls: rows with a null id, a null or zero vector, or null or non-finite components take no part. Shorter
vectors are filled with zeros. Repeated rows are candidates each. A table without queries or
candidates gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_k, finite_vectors, search_cells


def collision_cell(k: int, projections: int = 128, threshold: float = 0.615, radius: float = 0.5, growth: float = 1.5, seed: int = 5):
    """The search of one cell."""

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares within range
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def cell(query_ids, queries, ids, rows):
        reach = radius
        queries, rows = unit(queries), unit(rows)
        directions = np.random.default_rng(seed).standard_normal((rows.shape[1], projections))
        projected = rows @ directions
        order = np.argsort(projected, axis=0, kind="stable")
        n = len(ids)
        places = np.empty((projections, n), np.uint16 if n < 2**16 else np.uint32)
        arrays = np.empty((projections, n))
        for j in range(projections):
            places[j, order[:, j]] = np.arange(n, dtype=places.dtype)
            arrays[j] = projected[order[:, j], j]
        centres = queries @ directions
        need = int(np.ceil(threshold * projections))
        found, waiting = [], np.arange(len(queries))
        verified = np.zeros((len(queries), n), bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        count = np.empty(n, np.uint8 if projections < 256 else np.uint16)
        while len(waiting):
            low = np.array([np.searchsorted(arrays[j], centres[waiting, j] - reach, "left") for j in range(projections)])
            high = np.array([np.searchsorted(arrays[j], centres[waiting, j] + reach, "right") for j in range(projections)])
            left = []
            for w, i in enumerate(waiting):
                count[:] = 0
                if reach >= 2:  # no two unit vectors are farther apart
                    count[:] = need
                else:
                    first, width = low[:, w].astype(places.dtype), (high[:, w] - low[:, w]).astype(places.dtype)
                    for j in range(projections):
                        count += (places[j] - first[j]) < width[j]  # below the window the difference wraps around
                new = np.flatnonzero((count >= need) & ~verified[i] & (ids != query_ids[i]))
                verified[i, new] = True
                at, cosine = np.concatenate([best[i][0], new]), np.concatenate([best[i][1], rows[new] @ queries[i]])
                keep = best_k(cosine, ids[at], k)
                best[i] = at[keep], cosine[keep]
                near = len(keep) == k and 2 - 2 * cosine[keep[-1]] <= reach * reach
                if near or reach >= 2:
                    found.append((np.full(len(keep), query_ids[i]), ids[best[i][0]], best[i][1]))
                else:
                    left.append(i)
            waiting, reach = np.array(left, np.int64), reach * growth
        return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3

    return cell


def nearest_by_collisions(
    embeddings: DataFrame, k: int = 5, every: int = 50, block: int = 128, shard: int = 16_384, **options
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, by cosine."""
    vectors = finite_vectors(embeddings).where(F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0))
    return search_cells(vectors, every, k, block, shard, collision_cell(k, **options))
