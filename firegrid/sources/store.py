"""Result sinks and the per-region document store."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Folders that documents are dealt to.
BUCKETS = 256


def write_documents(docs: DataFrame, path: str, key: str = "pyrome") -> None:
    """One JSON document per region, one file in a folder of its own."""
    docs.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def _folder(ident: str) -> str:
    """A partition value as folder names have it."""
    escaped = re.sub(
        r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", ident
    )
    return escaped or "__HIVE_DEFAULT_PARTITION__"


def read_document(
    spark: SparkSession, path: str, ident: str | int, key: str = "pyrome",
    values: str | None = None, schema: StructType | str | None = None,
) -> DataFrame:
    """Document of one region; only its folder is read, and its schema unless one is given. Ids
    are strings, as written. ``values`` returns that field alone. An unknown region raises
    ``FileNotFoundError``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        found = reader.json(f"{path}/{key}={_folder(str(ident))}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no document for {ident!r} in {path}") from error
    return found.select(values) if values else found.withColumn(key, F.lit(str(ident)))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def write_document_buckets(docs: DataFrame, path: str, key: str = "pyrome", buckets: int = BUCKETS) -> None:
    """Documents dealt by the hash of their key to ``buckets`` folders of Parquet, sorted by key in each file, so
    that a lookup opens few folders and skips most row groups of those."""
    dealt = docs.select("*", _bucket(key, buckets))
    # A folder's documents may be many, so they are spread over ranges of the key.
    ranged = dealt.repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup_documents(
    spark: SparkSession, path: str, wanted: DataFrame, key: str, schema: StructType, buckets: int = BUCKETS, values: str | None = None
) -> DataFrame:
    """Documents of all ids of ``wanted`` in one job, each id once; ``found`` is false, and all fields null, for ids without
    a document. ``values`` returns the key, that field and ``found``.

    Only the folders that an id can be in are listed and read; their numbers, at most ``buckets``, are the only thing that
    reaches the driver. Null ids have no document. ``schema`` and ``buckets`` are those of the writer.
    """
    ids = wanted.select(key).distinct().select(key, _bucket(key, buckets))
    used = sorted(r["bucket"] for r in ids.select("bucket").distinct().collect())
    stored = StructType([*schema.fields, StructField("bucket", IntegerType())])
    docs = spark.read.schema(stored).parquet(path).where(F.col("bucket").isin(used))
    docs = docs.withColumn("found", F.lit(True))
    joined = ids.join(docs, [key, "bucket"], "left").drop("bucket").withColumn("found", F.coalesce("found", F.lit(False)))
    return joined.select(key, values, "found") if values else joined


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes inside a value are doubled, as spreadsheets and readers of CSV expect."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_results(results: Mapping[str, DataFrame], out_dir: str) -> None:
    """Result tables under their report names, e.g. ``fl_change``, ``cs_change``, ``sdi_summary``,
    ``bp_change``, ``eNVC_project``, ``eNVC_landscape``."""
    for name, df in results.items():
        write_csv(df, f"{out_dir}/{name}")


def with_manifest_time(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn(
        "created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Paths and parameters of prepared runs, one JSON object per run, with a creation time."""
    with_manifest_time(manifest).write.mode("overwrite").json(path)


def write_text_documents(lines: DataFrame, path: str, key: str = "pyrome") -> None:
    """One text document per key. A document is a few dozen lines and is written by one task."""
    (
        lines.repartition(key)
        .sortWithinPartitions(key, "line_no")
        .select(key, "line")
        .write.mode("overwrite")
        .partitionBy(key)
        .text(path)
    )
