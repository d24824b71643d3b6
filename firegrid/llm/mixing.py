"""Mixing sources to target weights by Sainte-Lague apportionment.

The parties are the shards of a source (a source with much text has many), their votes the shard's words. A source's
target in words is cut into equal blocks; they go to the shards by the highest quotients ``votes / (2k + 1)``, and what
remains below a block goes, in words, to the shard whose quotient is next. So a source takes its rounded target, be it
smaller than a block or spread over thousands of shards. Only quotients that can be the last ones served are ranked: the
others are known to be above or below, whatever the votes. Inside a shard the documents lie on a ring in seeded order;
the quota is taken as whole rounds plus a run from a seeded start. A shard never takes more than ``cap`` times its words;
what it can't take goes to the source's other shards.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, the last; a
null id is hashed like any value. Repeated rows each have their place on the ring. Rows without words take no part and
are in shard 0. An empty table gives an empty result. A source without words has target 0. Other columns of the input
are ignored by ``mix_sources`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WORD, broadcast_checked, set_apart

WEIGHTS = (5, 2, 1)
# The most shards of a source; its quotients are ranked together.
SLOTS = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets of ``totals`` (source, source_size, n_rows), one row a source.

    Weights repeat over the sources by code point, null last. The level at which capped sources stop
    is found from running sums in the order in which sources reach their caps.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    rows = totals.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        share * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_w").over(rest)
    rows = rows.withColumn("_level", level)
    reached = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)
    target = F.least(F.col("_w") * F.coalesce(reached["_level"], F.lit(float("inf"))), F.col("_cap"))
    return rows.select("source", "source_size", "n_rows", target.cast("double").alias("target"))


def _quotas(sized: DataFrame, scratch: Scratch, shard_words: int, block_words: int, cap: float, **options) -> tuple[DataFrame, DataFrame]:
    """Targets by source, and (source, shard, words of the shard, words it takes).

    Documents are counted once, by source and one of ``SLOTS`` slots of the key; a shard is a range of slots.
    """
    slot = F.pmod("_key", F.lit(SLOTS)).cast("int").alias("_slot")
    cells = scratch.store(
        sized.groupBy("source", slot).agg(F.sum("_size").alias("_size"), F.sum((F.col("_size") > 0).cast("long")).alias("_n")), "cells"
    )
    totals = cells.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_n").alias("n_rows"))
    # About 500 words a row: a source of many short documents is cut by its documents.
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") * 500 / shard_words), F.lit(1))
    targets = scratch.store(
        source_targets(totals, cap=cap, **options).select(
            F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
            F.least(shards, F.lit(SLOTS)).cast("int").alias("_shards"),
        ),
        "targets",
    )
    rings = (
        cells.where("_size > 0").join(broadcast_checked(targets), F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("_source", _shard(F.col("_slot")).alias("_shard"), "_source_size", "_target", "_shards")
        .agg(F.sum("_size").alias("_ring"))
    )
    return targets, scratch.store(_apportioned(rings, block_words, cap), "quotas")


def _shard(slot: Column) -> Column:
    return F.floor(slot * F.col("_shards") / SLOTS).cast("int")


def _apportioned(rings: DataFrame, block_words: int, cap: float) -> DataFrame:
    """Words that each shard takes of its source's target: blocks by highest quotients, the rest in words.

    With ``h`` blocks for ``n`` shards, the divisor that rounds the votes to ``h`` seats is within a factor ``1 ± n / 2h``
    of the votes per seat, so a shard's seats are known up to a few; these are ranked, some four a shard.
    """
    block = F.lit(block_words).cast("long")
    quota = F.round("_target").cast("long")
    blocks, rest = F.floor(quota / block), F.pmod(quota, block)
    share = F.col("_ring") / F.col("_source_size")  # of the source's words
    half = F.col("_shards") / 2.0
    known = F.greatest(F.floor(share * (blocks - half)) - 1, F.lit(0)).cast("long")
    most = (F.ceil(share * (blocks + 1 + half)) + 2).cast("long")
    source = Window.partitionBy("_source")
    seats = (
        rings.withColumns({"_known": known, "_blocks": blocks, "_rest": rest})
        .withColumn("_k", F.explode(F.sequence("_known", most)))
        .withColumn("_first", F.col("_k") == F.col("_known"))
    )
    quotient = F.col("_ring") / (2.0 * F.col("_k") + 1.0)
    place = F.row_number().over(source.orderBy(quotient.desc(), "_shard", "_k"))
    seats = seats.withColumn("_place", place + F.sum(F.when(F.col("_first"), F.col("_known")).otherwise(0)).over(source))
    served = F.when(F.col("_place") <= F.col("_blocks"), block).when(F.col("_place") == F.col("_blocks") + 1, F.col("_rest")).otherwise(0)
    words = F.min("_known") * block + F.sum(served)
    shards = seats.groupBy("_source", "_shard", "_ring").agg(words.alias("_served"))
    # What full shards can't take goes to the others in order.
    shards = shards.withColumn("_most", F.floor(cap * F.col("_ring"))).withColumn("_words", F.least("_served", "_most"))
    over = F.sum(F.col("_served") - F.col("_words")).over(source)
    slack = F.col("_most") - F.col("_words")
    before = F.sum(slack).over(source.orderBy("_shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - slack
    more = F.greatest(F.lit(0), F.least(over - before, slack))
    return shards.select(
        F.col("_source").alias("_of"), F.col("_shard").alias("_in"), "_ring", (F.col("_words") + more).cast("long").alias("_words")
    )


def _taken(sized: DataFrame, targets: DataFrame, quotas: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Rows with words and what is taken of each: whole rounds and up to two word ranges (``_lo1.._hi2``)."""
    size, block = F.col("_size"), F.lit(block_words).cast("long")
    rows = _placed(sized.where("_size > 0"), targets)
    rows = rows.join(broadcast_checked(quotas), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_in"))).drop("_of", "_in")
    ring = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed), "_key"), "_key", "doc_id", "_size")
    rows = rows.withColumn("_at", F.sum(size).over(ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    rows = rows.withColumn("_rounds", F.floor(F.col("_words") / F.col("_ring"))).withColumn("_run", F.pmod("_words", "_ring"))
    start = block * F.pmod(F.xxhash64(F.lit(seed), "_source", "_shard"), F.ceil(F.col("_ring") / block))
    rows = rows.withColumn("_start", start)
    inside = lambda x: F.greatest(F.lit(0), F.least(x - F.col("_at"), size))
    end = F.col("_start") + F.col("_run")
    rows = (
        rows.withColumn("_lo1", inside(F.col("_start"))).withColumn("_hi1", inside(end))
        .withColumn("_lo2", inside(F.col("_start") - F.col("_ring")))
        .withColumn("_hi2", inside(end - F.col("_ring")))
    )
    part = F.col("_hi1") - F.col("_lo1") + F.col("_hi2") - F.col("_lo2")
    return rows.withColumn("_taken", F.col("_rounds") * size + part)


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    rows = sized.join(broadcast_checked(targets), F.col("source").eqNullSafe(F.col("_source")), "left")
    return rows.withColumn("_shard", _shard(F.pmod("_key", F.lit(SLOTS))))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
    block_words: int = 16, shard_words: int = 1 << 16, seed: int = 17,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Only (source, size, key) is stored and shuffled, once by (source, shard); rows without words are not shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.store(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"),
                    F.xxhash64("doc_id", "text").alias("_key")),
        "sizes",
    )
    targets, quotas = _quotas(sized, scratch, shard_words, block_words, weights=weights, share=share, cap=cap)
    none = _placed(sized.where("_size = 0"), targets).withColumns({"_shard": F.lit(0), "_taken": F.lit(0), "_words": F.lit(None)})
    columns = [
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").cast("long").alias("taken"), "source", F.col("_shard").alias("shard"), F.col("_words").cast("long").alias("shard_words"),
    ]
    return _taken(sized, targets, quotas, block_words, seed).select(columns).unionByName(none.select(columns))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
    block_words: int = 16, shard_words: int = 1 << 16, seed: int = 17,
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document once for every round, and once more
    with the words of the run if it holds some. Words of a cut document are joined by one space."""
    docs, restore = set_apart(docs, ("doc_id", "text", "source", "n_chars"))
    own = docs.columns
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(
        "*", word_count(F.col("text")).alias("_size"), F.xxhash64("doc_id", "text").alias("_key")
    )
    sizes = sized.select("source", "_size", "_key")
    targets, quotas = _quotas(sizes, scratch, shard_words, block_words, weights=weights, share=share, cap=cap)
    rows = _taken(sized, targets, quotas, block_words, seed).where("_taken > 0")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.concat(
        F.slice(words, F.col("_lo1").cast("int") + 1, (F.col("_hi1") - F.col("_lo1")).cast("int")),
        F.slice(words, F.col("_lo2").cast("int") + 1, (F.col("_hi2") - F.col("_lo2")).cast("int")),
    )
    part = F.col("_taken") - F.col("_rounds") * F.col("_size")
    texts = F.concat(
        F.array_repeat("text", F.col("_rounds").cast("int")),
        F.when(part == 0, F.array().cast("array<string>"))
        .when(part == F.col("_size"), F.array("text"))
        .otherwise(F.array(F.array_join(cut, " "))),
    )
    mixed = rows.select("*", F.explode(texts).alias("_text")).select(
        *[F.col("_text").alias("text") if c == "text" else
          F.char_length("_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in own]
    )
    return restore(mixed)
