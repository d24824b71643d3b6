"""Vectors for searches, and the blocks of queries against all rows.

A stated query set meets all rows in cells: queries are dealt to blocks and rows to shards by hash,
each side is copied once per block of the other, and a task holds one block and one shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fields

HIT = fields(("query_id", "long"), ("vec_id", "long"), ("score", "double"))


def finite_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is not null and has only finite components."""
    infinite = F.lit(float("inf"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vector").isNotNull() & ~odd
    )


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows; shorter vectors are filled with zeros."""
    rows = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    if out.size:
        out[np.arange(out.shape[1]) < lengths[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def search_cells(
    vectors: DataFrame, every: int, k: int, block: int, shard: int, cell: Callable, hit=HIT
) -> DataFrame:
    """Run ``cell(query ids, queries, row ids, rows)`` on every cell and keep each query's ``k`` best.

    Queries are the ids divisible by ``every``; of rows that share a query's id the smallest vector is
    the query, and none of them is its candidate. Ties go to the smaller id.
    """
    vectors = Scratch(vectors.sparkSession).store(vectors, "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_rows, n_queries = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard)), max(1, -(-n_queries // block))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))).withColumn("_shard", copies(shards))
    # The vector takes part in the hash, so that rows of one id are spread.
    right = vectors.withColumn("_shard", F.pmod(F.xxhash64(F.lit(2), "vec_id", "vector"), F.lit(shards))).withColumn("_block", copies(blocks))
    key = (F.col("_block") * shards + F.col("_shard")).cast("long").alias("_cell")
    left, right = left.select(key, "vec_id", "vector"), right.select(key, "vec_id", "vector")

    def searched(q, v):
        import pyarrow as pa

        kind = pa.float64() if hit["score"].dataType.simpleString() == "double" else pa.int64()
        found = [[], [], []]
        if q.num_rows and v.num_rows:
            a, b = same_width(matrix(q.column("vector")), matrix(v.column("vector")))
            found = cell(q.column("vec_id").to_numpy(), a, v.column("vec_id").to_numpy(), b)
        arrays = [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), kind))]
        return pa.Table.from_arrays(arrays, names=hit.names)

    hits = left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(searched, hit)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
