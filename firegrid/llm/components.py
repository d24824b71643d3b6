"""Connected components of links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, label): the least node reachable, for every node of ``links`` (a, b) that has a link.

    Large-star and small-star steps alternate until every edge points at a node that points nowhere.
    A step sends each edge to one of its ends, whose least neighbour is found with partial sums; each
    round is stored, so that a lost executor costs one round.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = scratch.store(edges, f"{name}_0")
    turn = 0
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b")).where(a != b)
        turn += 1
        following = scratch.store(small.distinct(), f"{name}_{turn}")
        # Done when no node has two parents and no parent has one of its own.
        parents = following.groupBy("a").agg(F.count("*").alias("n"))
        more = parents.where("n > 1").select("a").unionByName(following.select(b.alias("a")).join(parents.select("a"), "a", "left_semi"))
        edges, before = following, f"{name}_{turn - 1}"
        finished = more.isEmpty()
        scratch.drop(before)
        if finished:
            break
    nodes = edges.select(a.alias("node"), b.alias("label"))
    return scratch.store(nodes.unionByName(edges.select(b.alias("node"), b.alias("label")).distinct()), name)
