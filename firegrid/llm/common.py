"""Shared pieces: a scratch folder all executors see, checked broadcasts, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

# Java pattern of a word: white space is the six ASCII characters only.
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of one Arrow batch given to a Python worker, so that long texts don't come ten thousand at a time.
BATCH_BYTES = 16 * 1024 * 1024

# Bytes up to which a stored side is replicated to every executor.
BROADCAST_BYTES = 24 * 1024 * 1024

_VOCABULARY = 150_000


class Scratch:
    """Parquet tables in a fresh folder below ``spark.checkpoint.dir``.

    A stored table cuts the lineage, survives lost executors and can be read column by column.
    Only a local session without that setting gets a private folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            shared = context.getConf().get("spark.checkpoint.dir")
            if shared is None and not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        limit_batches(spark)
        self.base = f"{context.getCheckpointDir()}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table read back."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a stored table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def set_apart(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns an operator works on and all others in one struct, whatever their names are, and what
    gives a result the columns of ``docs`` back."""
    names = docs.columns
    own = [c for c in names if c in used]
    field = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [c for c in names if c not in used]
    kept = F.struct(*map(field, others)) if others else F.lit(None).cast("string")
    packed = docs.select(*own, kept.alias("others"))

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in own else F.col("others").getField(c).alias(c) for c in names])

    return packed, restore


def limit_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, unless it has a lower bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(task: Callable) -> Callable:
    """A task for ``mapInArrow`` after which the worker, which is used again, gives freed memory back to the system."""

    def run(batches):
        yield from task(batches)
        release_memory()

    return run


def release_memory() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def broadcast_checked(stored: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a stored side only if its measured size is within the bound.

    A row counts as 16 bytes a column, strings, binaries and arrays with their content. Above the
    bound the join shuffles both sides, and adaptive execution splits hot keys.
    """
    row = F.lit(16 * len(stored.columns))
    for field in stored.schema:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind.startswith("array"):
            row = row + F.coalesce(F.size(field.name), F.lit(0)) * 40
    size = stored.select(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(stored) if size <= max_bytes else stored


_KINDS = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType(), "boolean": BooleanType()}


def fields(*pairs: tuple[str, object]) -> StructType:
    """A schema of nullable columns; types by name or as objects."""
    schema = StructType()
    for name, kind in pairs:
        schema = schema.add(name, _KINDS.get(kind, kind) if isinstance(kind, str) else kind, True)
    return schema


class _Words(dict):
    """64-bit hash of a word, remembered; emptied when the vocabulary outgrows its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1_000_000:
            _powers[base] = have
    return have[:n]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, by prefix sums of a polynomial modulo 2^64."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(_INVERSE, n), out=sums[1:], dtype=np.uint64)
    return mix((sums[k:] - sums[:-k]) * _power(_BASE, n)[: n - k + 1] + np.uint64(k))


def text_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
