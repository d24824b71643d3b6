"""N-gram Jaccard join by size-aware heavy-light candidates.

Documents link when ``100 * |A & B| >= 75 * |A | B|`` for their sets of word shingles. Equal sets are one set.
Every set is cut to a prefix in one global order (frequent shingles last), long enough that linked sets share
some of it:

* light sets (few shingles) enumerate the two-element subsets of their prefix,
* heavy sets put each element of their prefix in an inverted list.

The size that parts them has the least cost, estimated from the sizes of all sets and from how often
shingles recur; light sets can link to somewhat larger ones, which therefore do both.

First, neighbours in the lists, which are all in one random order, are verified where they share enough keys; this
joins most copies. Then a set is compared with the list members of other components only: shared prefix elements
are counted over its lists, and the few pairs that could still reach the similarity are verified. A list of many such
pairs is dealt out in blocks, and only members are paired whose places in the prefix leave enough overlap.
A pair within one component needs no verdict.

The order of frequent shingles is a hint: it holds the ``hint_size`` most frequent ones and decides
the cost only, never the result. Sets and shingles are compared by 64-bit hashes.

Nulls: a null text and a text without words have an empty set and link with nothing; null ids are kept, and a
component's id is the smallest that is not null. Fewer words than a shingle are one shingle. Repeated rows are
equal sets. An empty table gives an empty result. Other columns of the input are ignored by
``jaccard_components`` and kept by ``one_per_component``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_checked, fields, gram_hashes, lean, mix, set_apart, text_bytes, word_hashes
from .components import connected_components

SHINGLE = 5
PERCENT = 75
HINT_SIZE = 200_000
BUCKET_ENTRIES = 1_000_000
# Places that neighbours in a list are apart. All lists are in one order, so sets that are neighbours in it meet in
# nearly all lists they share. It is the order of the ids, which are hashes: neighbours are random, and a group
# of copies that link with a part of each other becomes one component.
_STEPS = tuple(range(1, 17))
_BORDERS = (0, 4, 8, 16, 32)
_COUNTED = 500_000
# A list of which more pairs than this times its length are in different components is paired by places and in blocks.
_DENSE = 32
_BLOCK_MEMBERS = 1024
_BITS = tuple(f"bits{i}" for i in range(4))
_ENTRY = np.dtype([("k", "<u8"), ("s", "<i8"), ("w", "<u8"), ("n", "<u4"), ("p", "<u4")])


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, in lower case A-Z."""
    words = word_hashes((text or b"").lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(size, len(words))))


def set_id(shingles: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


def _least_overlap(n: np.ndarray | int, percent: int):
    """What a set of ``n`` shares at least with a linked one."""
    return -(-percent * n // 100)


def _linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def survey(docs: DataFrame, shingle: int) -> DataFrame:
    """One scan: rows of kind 0 (doc_id, text hash, set id, set size), kind 1 (shingle hash, count in a part of the
    input, where at least 2) and kind 2 (set size, sets, recurrences of their shingles)."""
    kind = docs.schema["doc_id"].dataType
    schema = fields(("kind", "int"), ("doc_id", kind), ("text_hash", "long"), ("h", "long"), ("n", "long"), ("x", "double"))

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        held: list[np.ndarray] = []

        def counts():
            if not held:
                return
            sizes = np.array([len(s) for s in held])
            values, places, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            again = np.add.reduceat(times[places] - 1, np.r_[0, np.cumsum(sizes)[:-1]])
            much = times >= 2
            yield from rows(1, values[much].view("<i8"), times[much])
            by_size = np.minimum(sizes, 64)
            n_sets, extra = np.bincount(by_size, minlength=65), np.bincount(by_size, weights=again, minlength=65)
            some = np.flatnonzero(n_sets)
            yield from rows(2, some, n_sets[some], extra[some])
            held.clear()

        def rows(which, h, n, x=None, batch=None):
            m = len(h)
            if m:
                own = [pa.nulls(m, id_type), pa.nulls(m, pa.int64())] if batch is None else [batch.column("doc_id"), batch.column("text_hash")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([which] * m, pa.int32()), *own, pa.array(h, pa.int64()),
                     pa.array(n, pa.int64()), pa.nulls(m, pa.float64()) if x is None else pa.array(x, pa.float64())],
                    names=schema.names,
                )

        id_type, held_size = None, 0
        for batch in batches:
            ids, sizes = [], []
            id_type = batch.column("doc_id").type
            for text in text_bytes(batch.column("text")):
                shingles = shingle_set(text, shingle)
                own = set_id(shingles) if len(shingles) else 0
                ids.append(own)
                sizes.append(len(shingles))
                if len(shingles) and own not in seen:
                    seen.add(own)
                    held.append(shingles)
                    held_size += len(shingles)
                    if held_size > _COUNTED:
                        yield from counts()
                        held_size = 0
            yield from rows(0, np.array(ids, np.int64), sizes, batch=batch)
        yield from counts()

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(found), schema)


def heavy_border(surveyed: DataFrame, percent: int) -> int:
    """The largest light size, of least cost: subsets made, or list entries and partners met in lists."""
    sizes = surveyed.where("kind = 2").groupBy("h").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    size = np.array([r["h"] for r in sizes], float)
    sets, again = np.array([r["n"] for r in sizes], float), np.array([r["x"] for r in sizes], float)
    prefix = size - np.ceil(size * percent / 100) + 1
    subsets = sets * (prefix + 1) * prefix / 2
    lists = sets * prefix + again * prefix / np.maximum(size, 1)
    cost = {b: subsets[size <= b * 100 / percent].sum() + lists[size > b].sum() for b in _BORDERS}
    return min(_BORDERS, key=lambda b: (cost[b], b))


class Order:
    """The global order of shingles: the frequent ones last, by frequency, others by hash."""

    def __init__(self, frequent: np.ndarray):
        self.sorted = np.sort(frequent)
        self.rank = np.argsort(frequent, kind="stable").astype(np.uint64)

    def prefix(self, shingles: np.ndarray, length: int) -> np.ndarray:
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, shingles), len(self.sorted) - 1)
            frequent = self.sorted[at] == shingles
            if frequent.any():
                late = at[frequent]
                late = late[np.argsort(self.rank[late], kind="stable")]
                return np.concatenate([shingles[~frequent], self.sorted[late]])[:length]
        return shingles[:length]

    def place(self, shingle: np.uint64) -> int:
        """A number that grows with the order."""
        at = int(np.searchsorted(self.sorted, shingle))
        if at < len(self.sorted) and self.sorted[at] == shingle:
            return (1 << 63) + int(self.rank[at])
        return int(shingle) >> 1


def signature_keys(shingles: np.ndarray, order: Order, border: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one set, even for subsets of two prefix elements, odd for single elements, and for each
    the place of the prefix' end in the order and the place of its (last) element in the prefix."""
    n, one = len(shingles), np.uint64(1)
    prefix = order.prefix(shingles, n - _least_overlap(n, percent) + 2)
    keys, ends, places = [], [], []
    if n > border:
        single = prefix[: n - _least_overlap(n, percent) + 1]
        keys.append(mix(single) | one)
        ends.append(np.full(len(single), order.place(single[-1]), np.uint64))
        places.append(np.arange(len(single)))
    if n <= border * 100 // percent and len(prefix) > 1:
        i, j = np.triu_indices(len(prefix), 1)
        pairs = np.sort(np.stack([prefix[i], prefix[j]]), axis=0)
        keys.append(mix(pairs[0] * np.uint64(0x9E3779B97F4A7C15) + mix(pairs[1])) & ~one)
        ends.append(np.full(len(i), order.place(prefix[-1]), np.uint64))
        places.append(j)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(ends), np.concatenate(places)


def _signatures(docs: DataFrame, frequent, border: int, buckets: int, shingle: int, percent: int) -> DataFrame:
    schema = fields(("bucket", "int"), ("body", "binary"))

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        order, seen = Order(frequent.value), set()

        def out(parts: list[np.ndarray]):
            rows = np.concatenate(parts) if parts else np.empty(0, _ENTRY)
            bucket = (mix(rows["k"]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")  # rows of one set stay together and compress well
            bucket, rows = bucket[by], rows[by]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else np.empty(0, np.int64)
            bodies = [b"".join(rows[c][a:b].tobytes() for c in "kswnp") for a, b in zip(first, np.r_[first[1:], len(rows)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(bodies, pa.binary())], names=schema.names)

        for batch in batches:
            parts, size = [], 0
            for text in text_bytes(batch.column("text")):
                shingles = shingle_set(text, shingle)
                own = set_id(shingles)
                if not len(shingles) or own in seen:
                    continue
                seen.add(own)
                keys, ends, places = signature_keys(shingles, order, border, percent)
                rows = np.empty(len(keys), _ENTRY)
                rows["k"], rows["s"], rows["w"], rows["n"], rows["p"] = keys, own, ends, len(shingles), places
                parts.append(rows)
                size += len(rows)
                if size > _COUNTED:
                    yield out(parts)
                    parts, size = [], 0
            yield out(parts)

    return docs.select("text").mapInArrow(lean(made), schema)


_LIST = fields(("key", "long"), ("members", "binary"), ("sizes", "binary"), ("ends", "binary"), ("places", "binary"))


def _lists(signatures: DataFrame) -> DataFrame:
    """(key, members, sizes, ends, places): lists of two or more sets that share a key, in the order of the ids."""

    def gathered(table):
        import pyarrow as pa

        bodies = table.column("body").to_pylist()
        rows = np.empty(sum(map(len, bodies)) // _ENTRY.itemsize, _ENTRY)
        at = 0
        for body in bodies:
            m = len(body) // _ENTRY.itemsize
            rows["k"][at : at + m] = np.frombuffer(body, "<u8", m)
            rows["s"][at : at + m] = np.frombuffer(body, "<i8", m, 8 * m)
            rows["w"][at : at + m] = np.frombuffer(body, "<u8", m, 16 * m)
            rows["n"][at : at + m] = np.frombuffer(body, "<u4", m, 24 * m)
            rows["p"][at : at + m] = np.frombuffer(body, "<u4", m, 28 * m)
            at += m
        rows = rows[np.lexsort((rows["p"], rows["s"], rows["k"]))]
        if len(rows):
            new = np.r_[True, (rows["k"][1:] != rows["k"][:-1]) | (rows["s"][1:] != rows["s"][:-1])]
            rows = rows[new]
        first = np.flatnonzero(np.r_[True, rows["k"][1:] != rows["k"][:-1]]) if len(rows) else np.empty(0, np.int64)
        end = np.r_[first[1:], len(rows)]
        keep = end - first > 1
        first, end = first[keep], end[keep]
        bodies = [[column[x:y].tobytes() for x, y in zip(first, end)] for column in (np.ascontiguousarray(rows[c]) for c in "snwp")]
        keys = pa.array(np.ascontiguousarray(rows["k"][first]).view("<i8"))
        return pa.Table.from_arrays([keys, *(pa.array(x, pa.binary()) for x in bodies)], names=_LIST.names)

    return signatures.groupBy("bucket").applyInArrow(gathered, _LIST)


_PAIR = fields(("a", "long"), ("b", "long"))


def _flat(batch) -> tuple[np.ndarray, ...]:
    """Members, sizes, prefix ends, keys, places in their list and in the prefix of all lists of a batch, list after list."""
    bodies = batch.column("members").to_pylist()
    length = np.array([len(b) // 8 for b in bodies], np.int64)
    s = np.frombuffer(b"".join(bodies), "<i8")
    n = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), "<u4").astype(np.int64)
    w = np.frombuffer(b"".join(batch.column("ends").to_pylist()), "<u8")
    start = np.repeat(np.cumsum(length) - length, length)
    p = np.frombuffer(b"".join(batch.column("places").to_pylist()), "<u4").astype(np.int64)
    return s, n, w, np.repeat(batch.column("key").to_numpy(), length), np.arange(len(s)) - start, p


def _rest(n: np.ndarray, m: np.ndarray, v: np.ndarray, w: np.ndarray, odd: np.ndarray, percent: int) -> np.ndarray:
    """What sets of ``n`` and ``m`` shingles with prefix ends ``v`` and ``w`` can share besides the elements that both
    have in their prefixes: the rest of the set whose prefix ends first."""
    return np.maximum(_least_overlap(np.where(v <= w, n, m), percent) - np.where(odd, 1, 2), 0)


_COUNT = fields(("a", "long"), ("b", "long"), ("n", "long"), ("m", "long"), ("rest", "long"), ("odd", "boolean"), ("times", "long"))


def _can_link(percent: int, border: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that share ``times`` keys of one kind could link. Keys of the kind
    that does not decide for these sizes are left out."""
    times, n, m, odd = (F.col(c) for c in ("times", "n", "m", "odd"))
    shared = F.when(odd, times).otherwise(F.floor((1 + F.sqrt(1 + 8 * times)) / 2))  # c (c - 1) / 2 subsets of two
    need = F.ceil((n + m) * percent / (100 + percent))
    return (shared + F.col("rest") >= need) & (odd != (F.least(n, m) <= border))


def _neighbours(lists: DataFrame, percent: int, border: int) -> DataFrame:
    """Pairs (a, b) of list members a few places apart that share enough keys there to be able to link.

    Pairs may share more keys in lists where they stand farther apart; such pairs are left to the
    full counts of the second step.
    """

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s, n, w, key, _, _ = _flat(batch)
            parts = []
            for step in _STEPS:
                i = np.flatnonzero((key[:-step] == key[step:]) & (100 * np.minimum(n[:-step], n[step:]) >= percent * np.maximum(n[:-step], n[step:])))
                j, odd = i + step, key[i] & 1
                rows = np.stack([s[i], s[j], n[i], n[j], _rest(n[i], n[j], w[i], w[j], odd == 1, percent), odd], axis=1)
                swap = rows[:, 0] > rows[:, 1]
                rows[swap] = rows[swap][:, [1, 0, 3, 2, 4, 5]]
                parts.append(rows)
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows[:, 5], rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.r_[True, (rows[1:, [0, 1, 5]] != rows[:-1, [0, 1, 5]]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
            times, rows = np.diff(np.r_[first, len(rows)]), rows[first]
            columns = [np.ascontiguousarray(rows[:, i]) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(rows[:, 5] == 1), pa.array(times, pa.int64())], names=_COUNT.names
            )

    counts = lists.mapInArrow(near, _COUNT).groupBy("a", "b", "n", "m", "rest", "odd").agg(F.sum("times").alias("times"))
    return counts.where(_can_link(percent, border)).select("a", "b")


def _homes(lists: DataFrame) -> DataFrame:
    """(s, home): where a set's pairs are verified. Sets that share much have the same least key; long lists
    are cut into stretches of neighbours."""
    schema = fields(("s", "long"), ("key", "long"), ("part", "int"))

    def least(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s, _, _, key, part, _ = _flat(batch)
            part = part // 512
            if len(s):
                by = np.lexsort((part, key, s))
                s, key, part = s[by], key[by], part[by]
                first = np.r_[True, s[1:] != s[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[first]), pa.array(key[first]), pa.array(part[first].astype(np.int32))], names=schema.names
                )

    rows = lists.mapInArrow(least, schema)
    home = rows.groupBy("s").agg(F.min(F.struct("key", "part")).alias("h"))
    return home.select("s", F.xxhash64("h.key", "h.part").alias("home"))


def _verify(pairs: DataFrame, homes: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The linked pairs. A pair goes to the home of its first set, or to its two sets' if these differ; each
    set is sent once to every place that needs it, and shared shingles are counted there."""
    home = lambda c: homes.select(F.col("s").alias(c), F.col("home").alias(f"home_{c}"))
    placed = pairs.join(home("a"), "a").join(home("b"), "b")
    place = F.when(F.col("home_a") == F.col("home_b"), F.col("home_a")).otherwise(
        F.xxhash64(F.least("home_a", "home_b"), F.greatest("home_a", "home_b"))
    )
    placed = placed.select("a", "b", F.pmod(place, F.lit(tasks)).alias("place"))
    needed = placed.select("place", F.explode(F.array("a", "b")).alias("s")).distinct()
    shipped = needed.join(sets, "s").select(F.col("place").alias("at"), "s", "shingles")

    def judged(left, right):
        import pyarrow as pa

        own = {s: np.frombuffer(b, "<u8") for s, b in zip(right.column("s").to_pylist(), right.column("shingles").to_pylist())}
        out = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = own[a], own[b]
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if _linked(shared, len(x), len(y), percent):
                out.append((a, b))
        columns = list(zip(*out)) or [(), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_PAIR.names)

    return placed.groupBy("place").cogroup(shipped.groupBy("at")).applyInArrow(judged, _PAIR)


def _largest_partner(n, p, odd, percent: int):
    """The size of the largest set that one of ``n`` shingles can link to if the first key they share ends at place ``p``:
    ``percent * (n + m) / (100 + percent)`` shingles must be shared, and from there on are ``n - p``."""
    return (n - p + np.where(odd, 0, 1)) * (100 + percent) // percent - n


def _open_pairs(lists: DataFrame, labels: DataFrame, percent: int, border: int, buckets: int, scratch: Scratch, dense: int = _DENSE) -> DataFrame:
    """Pairs of different components that share enough prefix elements to be able to link.

    In each list a set is paired with the members of larger components; the pairs of a set are gathered by
    set, as blobs, and counted over its lists. Dense lists, with many members of different components, are cut into
    blocks, and two members are paired only where the list could be the first that they share. Pairs that meet in
    other lists may share more keys in dense ones. Every set has the number of its dense keys (``u``) and a bitmap of their
    hashes; a pair shares at most what either has less the bits that the other lacks. That bound stands for all dense
    keys of a pair, so pairs made in dense lists count nothing by themselves.
    """
    schema = fields(("key", "long"), ("s", "long"), ("n", "long"), ("w", "long"), ("p", "long"))

    def flat(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s, n, w, key, _, p = _flat(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, s, n, w.view("<i8"), p)], names=schema.names)

    def labelled_rows(some: DataFrame) -> DataFrame:
        rows = some.select(*lists.columns).mapInArrow(flat, schema)
        return rows.join(labels.select(F.col("node").alias("s"), "label", "weight"), "s", "left").select(
            F.pmod("key", F.lit(buckets)).alias("bucket"), "key", "s", "n", "w", "p",
            F.coalesce("label", "s").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight"),
        )

    # Only lists of over 2 * dense members can have so many pairs.
    by_label = labelled_rows(lists.where(F.octet_length("members") > 16 * dense)).groupBy("key", "label").agg(
        F.count("*").alias("c"), F.min("n").alias("least")
    )
    by_key = by_label.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("least").alias("least"))
    hot = scratch.store(by_key.where(F.col("c") * F.col("c") - F.col("same") > 2 * dense * F.col("c")).select("key", "c", "least"), "hot")
    hot = broadcast_checked(hot)
    hot_rows = labelled_rows(lists.join(hot, "key", "left_semi"))
    odd = F.pmod("key", F.lit(2)) == 1
    place = F.pmod(F.xxhash64("key"), F.lit(64 * len(_BITS)))
    bit = lambda i: F.when(F.floor(place / 64) == i, F.expr("shiftleft(1L, CAST(pmod(xxhash64(key), 64) AS INT))")).otherwise(0)
    bitmaps = [F.bit_or(bit(i)).alias(name) for i, name in enumerate(_BITS)]
    uncounted = scratch.store(hot_rows.groupBy("s", odd.alias("odd")).agg(F.count("*").alias("u"), *bitmaps), "uncounted")
    uncounted = broadcast_checked(uncounted.withColumnsRenamed({"s": "_s", "odd": "_odd"}))
    with_u = lambda rows: rows.join(uncounted, (F.col("s") == F.col("_s")) & (odd == F.col("_odd")), "left").drop("_s", "_odd").fillna(
        0, ["u", *_BITS]
    )
    labelled = with_u(labelled_rows(lists.join(hot, "key", "left_anti")))
    # A member that is too far back for even the least partner it could have in the list is left out.
    extra = F.when(odd, 0).otherwise(1)
    reach = F.floor((F.col("n") - F.col("p") + extra) * (100 + percent) / percent) - F.col("n")
    blocks = F.ceil(F.col("c") / _BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("s"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    hot_rows = with_u(hot_rows.join(hot, "key").where(reach >= F.greatest("least", F.ceil(F.col("n") * percent / 100))))
    cells = hot_rows.withColumn("own", own).withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    probe = fields(("bucket", "long"), ("body", "binary"))
    entry = np.dtype([("s", "<i8"), ("t", "<i8"), ("n", "<u4"), ("m", "<u4"), ("rest", "<u4"), ("u", "<u4"), ("odd", "u1"), ("c", "u1")])

    def made(x, y, s, n, w, u, bits, odd, counts):
        part = np.empty(len(x), entry)
        part["s"], part["t"], part["n"], part["m"], part["odd"], part["c"] = s[x], s[y], n[x], n[y], odd, counts
        part["rest"] = _rest(n[x], n[y], w[x], w[y], odd == 1, percent)
        alone = lambda p, q: np.bitwise_count(bits[p] & ~bits[q]).sum(axis=1, dtype=np.int64)
        part["u"] = np.minimum(u[x] - alone(x, y), u[y] - alone(y, x))
        return part

    def bits_of(table, order=slice(None)):
        return np.stack([table.column(c).to_numpy() for c in _BITS], axis=1)[order].view("<u8")

    def gathered_by_set(out):
        import pyarrow as pa

        rows = np.concatenate(out) if out else np.empty(0, entry)
        where = (mix(rows["s"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, rows = where[order], rows[order]
        start = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(rows) else np.empty(0, np.int64)
        bodies = [rows[x:y].tobytes() for x, y in zip(start, np.r_[start[1:], len(rows)])]
        return pa.Table.from_arrays([pa.array(where[start]), pa.array(bodies, pa.binary())], names=probe.names)

    def cell_probes(table):
        key, s, n, w, p, label, weight, u, own, i, j = (
            table.column(c).to_numpy() for c in ("key", "s", "n", "w", "p", "label", "weight", "u", "own", "i", "j")
        )
        w, out, bits = w.view("<u8"), [], bits_of(table)
        odd = key[0] & 1
        reach = _largest_partner(n, p, odd == 1, percent)
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        for x in left:
            y = right[s[right] > s[x]] if i[0] == j[0] else right
            fits = (label[y] != label[x]) & (n[y] <= reach[x]) & (reach[y] >= n[x])
            y = y[fits & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if len(y):
                a, b = np.full(len(y), x), y
                # A pair is named from the set of the smaller component, as by ``probes``: its counts meet in one place.
                swap = (weight[a] > weight[b]) | (weight[a] == weight[b]) & (label[a] > label[b])
                out.append(made(np.where(swap, b, a), np.where(swap, a, b), s, n, w, u, bits, odd, 0))
        return gathered_by_set(out)

    def probes(table):
        key, s, n, w, label, weight, u = (table.column(c).to_numpy() for c in ("key", "s", "n", "w", "label", "weight", "u"))
        by = np.lexsort((s, label, weight, key))
        key, s, n, w, label, u, bits = key[by], s[by], n[by], w[by].view("<u8"), label[by], u[by], bits_of(table, by)
        # Lists of one component need no pairs.
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        length = np.diff(np.r_[first, len(key)])
        mixed = np.repeat(label[first] != label[first + length - 1], length) if len(key) else np.empty(0, bool)
        key, s, n, w, label, u, bits = key[mixed], s[mixed], n[mixed], w[mixed], label[mixed], u[mixed], bits[mixed]
        # A member meets those behind the run of its own label, so a run is passed over and never paired.
        new = np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])] if len(key) else np.empty(0, bool)
        run, starts = np.cumsum(new) - 1, np.r_[np.flatnonzero(new), len(key)]
        out, left, right = [], np.arange(len(key)), starts[run + 1] if len(key) else np.empty(0, np.int64)
        while len(left):
            stay = right < len(key)
            left, right = left[stay], right[stay]
            stay = key[left] == key[right]  # those with a member so many places on
            left, right = left[stay], right[stay]
            x, y = n[left], n[right]
            fits = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            out.append(made(left[fits], right[fits], s, n, w, u, bits, key[left[fits]] & 1, 1))
            right = right + 1
        return gathered_by_set(out)

    def counted(table):
        import pyarrow as pa

        rows = np.frombuffer(b"".join(table.column("body").to_pylist()), entry)
        rows = rows[np.lexsort((rows["odd"], rows["t"], rows["s"]))]
        new = np.r_[True, (rows["s"][1:] != rows["s"][:-1]) | (rows["t"][1:] != rows["t"][:-1]) | (rows["odd"][1:] != rows["odd"][:-1])] if len(rows) else np.empty(0, bool)
        first = np.flatnonzero(new)
        times = np.add.reduceat(rows["c"], first, dtype=np.int64) if len(rows) else np.empty(0, np.int64)
        rows = rows[first]
        times += rows["u"]
        swap = rows["s"] > rows["t"]
        columns = [np.where(swap, rows[y], rows[x]).astype(np.int64) for x, y in (("s", "t"), ("t", "s"), ("n", "m"), ("m", "n"))]
        n, m, rest, odd = columns[2], columns[3], rows["rest"].astype(np.int64), rows["odd"] == 1
        shared = np.where(odd, times, (1 + np.sqrt(1 + 8 * times)) // 2)
        some = shared + rest >= -(-percent * (n + m) // (100 + percent))
        arrays = [pa.array(np.ascontiguousarray(c[some])) for c in (*columns, rest, odd, times)]
        return pa.Table.from_arrays(arrays, names=_COUNT.names)

    gathered = labelled.groupBy("bucket").applyInArrow(probes, probe)
    gathered = gathered.unionByName(cells.groupBy("key", "i", "j").applyInArrow(cell_probes, probe))
    counts = gathered.groupBy("bucket").applyInArrow(counted, _COUNT)
    return counts.where(_can_link(percent, border)).select("a", "b").distinct()


def _sets(docs: DataFrame, members: DataFrame, pairs: DataFrame, scratch: Scratch, shingle: int, name: str) -> DataFrame:
    """(s, shingles) of the sets in ``pairs``, made again from the text of one document each."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    wanted = members.where("n > 0").join(named, "s", "left_semi").groupBy("s").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"))
    wanted = scratch.store(wanted.select(F.col("s").alias("_s"), F.col("d.doc_id").alias("_d"), F.col("d.text_hash").alias("_h")), f"wanted_{name}")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_t"), "text").join(
        broadcast_checked(wanted), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h"))
    )
    schema = fields(("s", "long"), ("shingles", "binary"))

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bodies = [shingle_set(text, shingle).tobytes() for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_s"), pa.array(bodies, pa.binary())], names=schema.names)

    return scratch.store(texts.select("_s", "text").mapInArrow(lean(made), schema), f"sets_{name}")


def _frequent(surveyed: DataFrame, hint_size: int) -> np.ndarray:
    """At most ``hint_size`` frequent shingles, the rarest first: those above a power of two."""
    import pyarrow.compute as pc

    counts = surveyed.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n"))
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()
    total, least = 0, 40
    for row in sorted(powers, key=lambda r: -r["p"]):
        total += row["count"]
        if total > hint_size:
            break
        least = row["p"]
    table = counts.where(F.col("n") >= F.lit(max(4, 2**least))).toArrow()
    order = pc.sort_indices(table, sort_keys=[("n", "ascending"), ("h", "ascending")])
    return table.column("h").take(order).to_numpy().view(np.uint64)


def set_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hint_size: int = HINT_SIZE, border: int | None = None,
    dense: int = _DENSE,
) -> DataFrame:
    """(doc_id, text_hash, n, s, component_id, label) of every document; ``s`` names its set and ``label`` its component,
    also where ids are null or repeated; null for documents without words. ``border`` sets the largest light size by
    hand."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    surveyed = scratch.store(survey(docs, shingle), "survey")
    members = surveyed.where("kind = 0").select("doc_id", "text_hash", "n", F.col("h").alias("s"))
    if border is None:
        border = heavy_border(surveyed, percent)
    frequent = spark.sparkContext.broadcast(_frequent(surveyed, hint_size))
    entries = members.select(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * (100 - percent) // 100
    buckets = max(24, entries // BUCKET_ENTRIES)
    tasks = max(64, entries // 200_000)
    lists = scratch.store(_lists(_signatures(docs, frequent, border, buckets, shingle, percent)), "lists")
    homes = scratch.store(_homes(lists), "homes")
    near = scratch.store(_neighbours(lists, percent, border), "near")
    sets = _sets(docs, members, near, scratch, shingle, "near")
    links = scratch.store(_verify(near, homes, sets, percent, tasks), "links")
    scratch.drop("sets_near")
    first = connected_components(links, scratch, "first")
    weight = first.groupBy("label").agg(F.count("*").alias("weight"))
    labels = broadcast_checked(scratch.store(first.join(weight, "label"), "labels"))
    open_pairs = _open_pairs(lists, labels, percent, border, buckets, scratch, dense).join(near, ["a", "b"], "left_anti")
    open_pairs = scratch.store(open_pairs, "open")
    sets = _sets(docs, members, open_pairs, scratch, shingle, "open")
    late = scratch.store(_verify(open_pairs, homes, sets, percent, tasks), "late")
    scratch.drop("sets_open")
    scratch.drop("lists")
    edges = first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(late)
    joined = connected_components(edges, scratch, "all")
    least = members.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    labelled = least.join(joined.withColumnRenamed("node", "s"), "s")
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = labelled.join(ids, "label").select("s", "component_id", "label")
    ids = least.join(linked.withColumnRenamed("component_id", "_linked"), "s", "left").select(
        F.col("s").alias("_s"), F.coalesce("_linked", "least").alias("_component"), F.coalesce("label", "s").alias("_label")
    )
    ids = broadcast_checked(scratch.store(ids, "ids"))
    rows = members.join(ids, (F.col("s") == F.col("_s")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_hash", "n", "s", component.alias("component_id"), F.col("_label").alias("label"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return set_components(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` per component, that of the smallest id; documents without words all stay.

    Components are told apart by their labels, as ids can be null or repeated. Only the rows to drop are joined, by
    (doc_id, text hash). Of repeated rows one stays.
    """
    docs, restore = set_apart(docs, ("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.store(set_components(docs, **options), "members")
    own = ["doc_id", "text_hash"]
    worded = rows.where("n > 0").groupBy("label", *own).agg(F.count("*").alias("copies"))
    kept = worded.groupBy("label").agg(F.min(F.struct(*own)).alias("kept"))
    judged = worded.join(kept, "label").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "copies",
        (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))).alias("_keep"),
    )
    judged = scratch.store(judged.where("not _keep or copies > 1"), "judged")
    marked = docs.withColumn("_text_hash", F.xxhash64("text")).join(
        broadcast_checked(judged), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_t")), "left"
    )
    single = marked.where("_keep is null")
    same = Window.partitionBy("doc_id", "_text_hash").orderBy("_keep")
    repeated = marked.where("_keep").withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return restore(single.select(*docs.columns).unionByName(repeated.select(*docs.columns)))
