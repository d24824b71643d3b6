"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots whose number never changes. Bytes are summed per slot,
and a stored map says which shard holds a slot. Rebalancing writes a new version of the map that
moves few slots; records keep their slot.

Nulls: a null text has no bytes and the checksum of the empty text; a null id is hashed like any
value. Empty texts count one byte. Repeated rows share a slot and get places of their own. An empty
table gives an empty result. Other columns of the input are ignored. A slot is the smallest unit, so
one text larger than a shard's share fills its shard alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fields

SLOTS = 4096
SHARDS = 16


def slotted(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record, in one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(records: DataFrame, n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and records of each slot; at most ``n_slots`` rows reach the driver."""
    size, count = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    for row in sums.collect():
        size[row["virtual_slot"]], count[row["virtual_slot"]] = row["b"], row["n"]
    return size, count


def first_map(n_slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """Version 0: equal ranges of slots."""
    return np.arange(n_slots) * shards // n_slots


def edited_map(before: np.ndarray, size: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Move slots off overfull shards, then swap single slots while the widest gap narrows."""
    owner = before.copy()
    load = np.bincount(owner, weights=size, minlength=shards)
    mean = load.sum() / shards
    for shard in np.argsort(-load, kind="stable"):
        while load[shard] > mean:
            own = np.flatnonzero((owner == shard) & (size > 0) & (size <= load[shard] - mean))
            if not len(own):
                break
            slot, to = own[np.argmax(size[own])], int(np.argmin(load))
            owner[slot] = to
            load[shard] -= size[slot]
            load[to] += size[slot]
    for _ in range(20 * shards):
        high, low = int(np.argmax(load)), int(np.argmin(load))
        gap = load[high] - load[low]
        a, b = np.flatnonzero(owner == high), np.flatnonzero(owner == low)
        b = b[np.argsort(size[b], kind="stable")]
        smaller = np.concatenate([[0], size[b]])  # the first stands for a plain move
        at = np.searchsorted(smaller, size[a] - gap / 2)
        best = None
        for shift in (0, -1):
            k = np.clip(at + shift, 0, len(smaller) - 1)
            given = size[a] - smaller[k]
            left = np.where((given > 0) & (given < gap), np.abs(gap - 2 * given), np.inf)
            if len(left) and (best is None or left.min() < best[0]):
                i = int(np.argmin(left))
                best = (left[i], a[i], k[i], given[i])
        if best is None or best[0] >= gap:
            break
        _, slot, k, given = best
        owner[slot] = low
        if k:
            owner[b[k - 1]] = high
        load[high] -= given
        load[low] += given
    return owner


def store_map(spark: SparkSession, path: str, version: int, owner: np.ndarray) -> None:
    """Add one version of the map to the table at ``path``."""
    rows = [(version, slot, int(shard)) for slot, shard in enumerate(owner)]
    schema = fields(("version", "int"), ("virtual_slot", "int"), ("shard", "int"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, np.ndarray]:
    """A stored version of the map, the newest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return version, np.array([row["shard"] for row in rows], np.int64)


def place(records: DataFrame, owner: np.ndarray, count: np.ndarray) -> DataFrame:
    """Shard and place of every record. Places run through a shard's slots in order of the slots, so
    that only the rows of one slot are numbered together."""
    start = np.zeros(len(owner), np.int64)
    for shard in np.unique(owner):
        own = np.flatnonzero(owner == shard)
        start[own] = np.concatenate([[0], np.cumsum(count[own])[:-1]])
    rows = [(s, int(owner[s]), int(start[s])) for s in range(len(owner))]
    lookup = records.sparkSession.createDataFrame(
        rows, fields(("virtual_slot", "int"), ("shard", "int"), ("first_place", "long"))
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.join(F.broadcast(lookup), "virtual_slot").withColumn(
        "slot", F.col("first_place") + F.row_number().over(inside) - 1
    )


def shard_by_slots(
    docs: DataFrame, shards: int = SHARDS, n_slots: int = SLOTS, map_path: str | None = None
) -> DataFrame:
    """Shard ``docs`` so that the shards' bytes are near equal.

    ``map_path`` names the folder of the versioned map; a new one is started there with equal slot
    ranges, and the edit that balances these records is stored as the next version.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    records = scratch.store(slotted(docs, n_slots), "records")
    size, count = slot_totals(records, n_slots)
    if map_path is None:
        map_path = scratch.path("slot_map")
        store_map(spark, map_path, 0, first_map(n_slots, shards))
    version, owner = load_map(spark, map_path)
    edited = edited_map(owner, size, shards)
    if (edited != owner).any():
        version += 1
        store_map(spark, map_path, version, edited)
    return place(records, edited, count).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        F.lit(version).alias("map_version"),
    )
