"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates are sorted along a Hilbert curve over their components and stored as Parquet, one row per block
of neighbours: ids, labels, components, and the zone map, which is the least and largest component of
every dimension and the block's labels with their counts. Interval arithmetic on a zone map bounds the inner
product of an anchor with any row of the block. A search asks for the best rows of given labels with scores
inside a window; an anchor reads the blocks that hold such a label, whose bounds meet the window and reach
the least score that the k-th best is sure to have, which comes from blocks that lie inside the window
altogether. Positives are a first search without limits, the windows they open are the second.

Zone maps are read without the blocks (column pruning) and meet chunks of anchors in cells; what was chosen
is an equi-join on the block, dealt by (chunk of anchors, shelf of neighbouring blocks). A task holds one
chunk and one shelf. Bounds decide cost, never the result; everything returned is compared by exact scores.

Components are integers, ``floor(scale * x)``; scores are exact, beyond a long they count as its end.

Nulls: rows with a null id, label or vector, or with null or non-finite components take no part. Shorter
vectors, empty ones too, are filled with zeros. Ties of score go to the smaller id. Rows of one id are
candidates each; of rows that share an anchor's id the one with the smallest label, then vector, is the
anchor, and none is its candidate. An anchor without positives, or a window without negatives, has no rows.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches
from .vectors import matrix

SCALE = 256
BLOCK = 256
SHELF = 32
CHUNK = 1024
PAGE = 8192
_BITS = 4
_AT_ONCE = 64
_END = 2**63 - 1
_BLOCKS = "block long, n int, labels array<long>, counts array<int>, low binary, high binary, ids binary, classes binary, components binary"
_CHOSEN = "chunk long, block long, anchors binary"
_HITS = "chunk long, place int, anchor_id long, wanted_for long, vec_id long, score long"


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    infinite = F.lit(float("inf"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)


def whole(column, width: int, scale: float) -> np.ndarray:
    rows = np.floor(scale * matrix(column))
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


# -- the curve ---------------------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of cells, whose coordinates have ``bits`` bits; bytes sort along the curve.

    The coordinates are turned into those of the curve level by level: what a level's bit of a dimension
    reflects or swaps with the first dimension is undone in all lower bits, then the bits are Gray decoded.
    """
    x = cells.astype(np.uint32).T.copy()
    if not x.size:
        return [b""] * len(cells)
    for level in range(bits - 1, 0, -1):
        lower = np.uint32((1 << level) - 1)
        for dimension in x:
            reflect = (dimension >> level) & 1 == 1
            swap = np.where(reflect, 0, (x[0] ^ dimension) & lower)
            x[0] ^= np.where(reflect, lower, swap)
            dimension ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0).astype(np.uint32)
    x ^= turn
    planes = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)]


def with_curve_place(rows: DataFrame, width: int, scale: float) -> DataFrame:
    """Rows with ``place`` on the curve; the grid spans three deviations around every dimension's mean."""

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((3, width))
        for batch in batches:
            x = np.clip(whole(batch.column("vector"), width, scale), -1e12, 1e12)
            total += np.stack([np.full(width, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *map(pa.array, total)], names=["d", "n", "s", "q"])

    parts = rows.select("vector").mapInArrow(sums, "d int, n double, s double, q double")
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("d").collect()
    n = max([r["n"] for r in found] + [1.0])
    mean = np.array([r["s"] for r in found]) / n
    deviation = np.sqrt(np.maximum(np.array([r["q"] for r in found]) / n - mean**2, 0))
    # The curve turns first along the dimensions that vary most.
    order = np.argsort(-deviation, kind="stable")
    step = np.where(deviation > 0, 6 * deviation / 2**_BITS, 1.0)

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = whole(batch.column("vector"), width, scale)
            cells = np.clip((x - mean) / step + 2 ** (_BITS - 1), 0, 2**_BITS - 1)[:, order]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, _BITS), pa.binary())], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(placed, "vec_id long, label long, vector array<double>, place binary")


# -- blocks ------------------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.float32 if np.abs(x).max(initial=0) < 2**24 else np.float64).tobytes()


def _unpack(blob: bytes, n: int, width: int) -> np.ndarray:
    kind = np.float32 if len(blob) == 4 * n * width else np.float64
    return np.frombuffer(blob, kind).reshape(n, width)


def packed_blocks(rows: DataFrame, size: int, per_task: int, count: int, width: int, scale: float) -> DataFrame:
    """Blocks of up to ``size`` rows next to each other on the curve, numbered along it."""

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 32
        held = None

        def block(part):
            x = whole(part.column("vector"), width, scale)
            classes = part.column("label").to_numpy()
            labels, counts = np.unique(classes, return_counts=True)
            row = [number, len(x), labels.tolist(), counts.tolist(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes()]
            row += [part.column("vec_id").to_numpy().tobytes(), classes.tobytes(), _narrow(x)]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.binary()] * 5
            names = ["block", "n", "labels", "counts", "low", "high", "ids", "classes", "components"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= size:
                yield block(held.slice(0, size).combine_chunks())
                held, number = held.slice(size), number + 1
        if held is not None and held.num_rows:
            yield block(held.combine_chunks())

    # The place in the stored table spreads rows that are equal in everything else.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))
    ranges = rows.withColumn("spread", spread).repartitionByRange(max(1, -(-count // per_task)), "place", "vec_id", "spread")
    ordered = ranges.sortWithinPartitions("place", "vec_id", "label", "vector").select("vec_id", "label", "vector")
    return ordered.mapInArrow(packed, _BLOCKS)


# -- choice of blocks ----------------------------------------------------------------------------------------


def interval_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product (anchor x block) that components between ``low`` and ``high`` allow."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    slack = 1e-12 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def sure_scores(lower: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The largest score that ``k`` rows are sure to reach, by row; blocks that don't count have 0 rows."""
    order = np.argsort(-lower, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(counts, order, axis=1), axis=1) >= k
    first = np.take_along_axis(lower, np.take_along_axis(order, reached.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
    return np.where(reached.any(axis=1), first, -np.inf)


def _wanted(row: dict, width: int) -> tuple[np.ndarray, ...]:
    """A chunk's ids, labels, components, and its windows: anchor's place, what for, least and largest score."""
    ids, classes = (np.frombuffer(row[c], np.int64) for c in ("ids", "classes"))
    windows = [np.frombuffer(row[c], np.int64) for c in ("at", "wanted_for", "least", "most")]
    return ids, classes, _unpack(row["components"], len(ids), width), *windows


class ZonePage:
    """Zone maps of some blocks, and the blocks and counts of every label."""

    def __init__(self, zones, width: int):
        self.blocks = zones.column("block").to_numpy()
        self.low, self.high = (np.frombuffer(b"".join(zones.column(c).to_pylist())).reshape(len(self.blocks), width) for c in ("low", "high"))
        self.rows = zones.column("n").to_numpy().astype(np.int64)
        held: dict[int, list[tuple[int, int]]] = {}
        for b, (labels, counts) in enumerate(zip(zones.column("labels").to_pylist(), zones.column("counts").to_pylist())):
            for label, count in zip(labels, counts):
                held.setdefault(label, []).append((b, count))
        self.of_label = {label: np.array(pairs).T for label, pairs in held.items()}

    def needed(self, chunk: tuple[np.ndarray, ...], k: int, same_label: bool) -> np.ndarray:
        """(block x anchor) whether one of the anchor's windows must read the block."""
        ids, classes, anchors, at, _, least, most = chunk
        found = np.zeros((len(ids), len(self.blocks)), bool)
        for begin in range(0, len(at), _AT_ONCE):
            part = slice(begin, begin + _AT_ONCE)
            lower, upper = interval_bounds(anchors[at[part]].astype(np.float64), self.low, self.high)
            rows = np.zeros(lower.shape, np.int64)
            for i, label in enumerate(classes[at[part]].tolist()):
                if label in self.of_label:
                    where, counts = self.of_label[label]
                    rows[i, where] = counts
            rows = rows if same_label else self.rows - rows
            low, high = least[part][:, None], most[part][:, None]
            # Rows inside a window altogether; with the anchor's label it may be one of them itself.
            inside = np.where((lower >= low) & (upper <= high), rows, 0)
            sure = sure_scores(lower, inside, k + int(same_label))
            np.logical_or.at(found, at[part], (rows > 0) & (upper >= np.maximum(low, sure[:, None])) & (lower <= high))
        return found.T


def choose_blocks(chunks: DataFrame, zones: DataFrame, n_chunks: int, n_blocks: int, width: int, k: int, same_label: bool) -> DataFrame:
    """(chunk, block, anchors): the blocks that the windows of a chunk's anchors must read, and whose they are."""
    pages, groups = max(1, -(-n_blocks // PAGE)), max(1, -(-n_chunks // 4))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chunks.withColumn("group", dealt("chunk", groups)).withColumn("page", copied(pages))
    right = zones.withColumn("page", dealt("block", pages)).withColumn("group", copied(groups))

    def chosen(dealt_chunks, zone):
        import pyarrow as pa

        found: list[tuple[int, int, bytes]] = []
        if dealt_chunks.num_rows and zone.num_rows:
            page = ZonePage(zone, width)
            for row in dealt_chunks.to_pylist():
                needed = page.needed(_wanted(row, width), k, same_label)
                for b in np.flatnonzero(needed.any(axis=1)):
                    found.append((row["chunk"], int(page.blocks[b]), np.flatnonzero(needed[b]).astype(np.int32).tobytes()))
        columns = list(zip(*found)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "block", "anchors"])

    return left.groupBy("group", "page").cogroup(right.groupBy("group", "page")).applyInArrow(chosen, _CHOSEN)


# -- search ------------------------------------------------------------------------------------------------


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchor x row): 32-bit floats where they are exact, else 64-bit floats, else longs."""
    top = lambda x: float(np.abs(x).max(initial=0))
    limit = top(anchors) * top(rows) * max(1, rows.shape[1])
    if limit < 2**53:
        kind = np.float32 if limit < 2**24 else np.float64
        return anchors.astype(kind) @ rows.astype(kind).T
    own = [[int(v) for v in row] for row in rows]
    return np.array([[min(max(sum(int(a) * b for a, b in zip(q, r)), -_END), _END) for r in own] for q in anchors], np.int64)


def best_in_windows(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, k: int):
    """(window, row) of the ``k`` best allowed rows of every window (a row of ``scores``), ties to the smaller id."""
    lowest = -np.inf if scores.dtype.kind == "f" else -_END - 1
    inside = allowed & (scores >= least[:, None].astype(scores.dtype)) & (scores <= most[:, None].astype(scores.dtype))
    open_ = np.where(inside, scores, scores.dtype.type(lowest))
    if open_.shape[1] > k:
        kth = np.partition(open_, open_.shape[1] - k, axis=1)[:, open_.shape[1] - k]
        inside &= open_ >= kth[:, None]
    window, row = np.nonzero(inside)
    order = np.lexsort((ids[row], -scores[window, row], window))
    window, row = window[order], row[order]
    first = np.searchsorted(window, np.arange(len(scores)))
    keep = np.arange(len(window)) - first[window] < k
    return window[keep], row[keep]


def search_blocks(chunks: DataFrame, blocks: DataFrame, chosen: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """(chunk, place, anchor_id, wanted_for, vec_id, score): the best rows of every window in every shelf."""
    chosen = chosen.withColumn("shelf", F.floor(F.col("block") / SHELF).cast("long"))
    cells = chosen.select(F.col("chunk").alias("to_chunk"), F.col("shelf").alias("to_shelf")).distinct()
    left = cells.join(chunks, F.col("to_chunk") == F.col("chunk"))
    right = chosen.join(blocks.select("block", "n", "ids", "classes", "components"), "block")

    def searched(chunk, shelf):
        import pyarrow as pa

        names = ["chunk", "place", "anchor_id", "wanted_for", "vec_id", "score"]
        kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 4
        found = []
        if chunk.num_rows and shelf.num_rows:
            asking = chunk.to_pylist()[0]
            ids, classes, anchors, at, wanted_for, least, most = _wanted(asking, width)
            held = shelf.to_pylist()
            needed = np.zeros((len(held), len(ids)), bool)
            for i, block in enumerate(held):
                needed[i, np.frombuffer(block["anchors"], np.int32)] = True
            its = [(np.frombuffer(b["ids"], np.int64), np.frombuffer(b["classes"], np.int64), _unpack(b["components"], b["n"], width)) for b in held]
            for begin in range(0, len(ids), _AT_ONCE):
                end = min(begin + _AT_ONCE, len(ids))
                read = np.flatnonzero(needed[:, begin:end].any(axis=1))
                own = np.flatnonzero((at >= begin) & (at < end))
                if not len(read) or not len(own):
                    continue
                row_ids, row_classes, rows = (np.concatenate([its[b][c] for b in read]) for c in range(3))
                scores = exact_scores(anchors[begin:end], rows)
                allowed = (row_classes == classes[begin:end, None]) == same_label
                allowed &= row_ids != ids[begin:end, None]
                window, row = best_in_windows(scores[at[own] - begin], allowed[at[own] - begin], row_ids, least[own], most[own], k)
                place = at[own][window]
                found.append((place, ids[place], wanted_for[own][window], row_ids[row], scores[place - begin, row].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 5
        columns = [np.full(len(columns[0]), asking["chunk"] if found else 0), *columns]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    hits = left.groupBy("to_chunk", "to_shelf").cogroup(right.groupBy("chunk", "shelf")).applyInArrow(searched, _HITS)
    best = Window.partitionBy("anchor_id", "wanted_for").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_windows(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """Chunks with their windows as columns of longs; chunks without any go."""
    per_chunk = windows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "wanted_for", "least", "most"))).alias("windows"))
    joined = chunks.join(per_chunk, "chunk")

    def as_columns(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.column("windows").to_pylist()
            blobs = [
                pa.array([np.array([w[name] for w in row], np.int64).tobytes() for row in rows], pa.binary())
                for name in ("place", "wanted_for", "least", "most")
            ]
            kept = [batch.column(c) for c in ("chunk", "ids", "classes", "components")]
            yield pa.RecordBatch.from_arrays(kept + blobs, names=["chunk", "ids", "classes", "components", "at", "wanted_for", "least", "most"])

    schema = "chunk long, ids binary, classes binary, components binary, at binary, wanted_for binary, least binary, most binary"
    return joined.select("chunk", "ids", "classes", "components", "windows").mapInArrow(as_columns, schema)


def hard_negatives(
    embeddings: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least_share: int = 30,
    most_share: int = 90,
    scale: float = SCALE,
    block: int = BLOCK,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the ids divisible by ``every``; negatives have another label and score between
    ``least_share`` and ``most_share`` hundredths of the positive's score.
    """
    spark = embeddings.sparkSession
    limit_batches(spark)
    scratch = scratch or Scratch(spark)
    rows = scratch.store(labelled_vectors(embeddings), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("w")).first()
    n, width = size["n"], size["w"] or 0
    # Long vectors come in smaller blocks and chunks, so that a task holds some megabytes at any width.
    block, chunk = (max(16, min(most, room // max(1, width))) for most, room in ((block, 2**18), (CHUNK, 2**20)))
    placed = scratch.store(with_curve_place(rows, width, scale), "placed")
    blocks = scratch.store(packed_blocks(placed, block, block * SHELF, n, width, scale), "blocks")
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "place")).alias("a"))
    asked = scratch.store(asked.select("vec_id", "a.*"), "asked")
    chunks = packed_blocks(asked, chunk, chunk, asked.count(), width, scale)
    chunks = scratch.store(chunks.select(F.col("block").alias("chunk"), "n", "ids", "classes", "components"), "chunks")
    zones = blocks.select("block", "n", "labels", "counts", "low", "high")
    n_chunks, n_blocks = chunks.count(), blocks.count()

    def searched(windows: DataFrame, name: str, k: int, same_label: bool) -> DataFrame:
        asking = scratch.store(with_windows(chunks, windows), f"{name}_asked")
        chosen = scratch.store(choose_blocks(asking, zones, n_chunks, n_blocks, width, k, same_label), f"{name}_chosen")
        return search_blocks(asking, blocks, chosen, width, k, same_label)

    long = lambda v: F.lit(v).cast("long")
    everything = chunks.select("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    everything = everything.select("*", long(0).alias("wanted_for"), long(-_END).alias("least"), long(_END).alias("most"))
    nearest = scratch.store(searched(everything, "positives", positives, True), "positives").withColumn("wanted_for", F.col("rank").cast("long"))
    # Whole scores at a window's ends; shares of a long can leave its range on the way.
    share = lambda hundredths: F.col("score").cast("decimal(20,0)") * hundredths / 100
    windows = nearest.select(
        "chunk", "place", "wanted_for", F.ceil(share(least_share)).cast("long").alias("least"), F.floor(share(most_share)).cast("long").alias("most")
    )
    hard = searched(windows.where("least <= most"), "negatives", negatives, False)
    asked_for = nearest.select("anchor_id", "wanted_for", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(asked_for, ["anchor_id", "wanted_for"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
