"""Session settings and the run-time size check behind every non-constant broadcast."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a side is replicated to every executor. At roughly 100 bytes a row this
# is about 50 MB, far below Spark's 8 GB broadcast limit.
BROADCAST_ROWS = 500_000

# Rows that one task makes where an operator turns a row into many.
TASK_ROWS = 500_000

# Settings of the context. Checkpoint files go when no table refers to them any more.
_CONTEXT_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Plan-time size estimates ignore the growth of an explode, so a rasterized layer can look
    # tiny before it runs. Only sizes measured at run time may trigger a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(48 * 1024 * 1024),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the library's run-time SQL settings to an existing session."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "firegrid", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the library's settings; the cluster may override any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_CONTEXT_CONF, **_RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the checkpoint folder, which all executors see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder of the cluster.

    The folder is the one named in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a private folder; a cluster must name a shared one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder, count it, and hint a broadcast only when
    the count is within the bound; above it the join shuffles instead.

    The side is stored because it is needed twice, for the count and for the join.
    """
    stored = checkpoint(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def spread(df: DataFrame, rows: Column | int, *by: str, per_task: int = TASK_ROWS) -> DataFrame:
    """Deal ``df`` by the columns ``by`` (without any: in turn) to so many tasks that each makes about ``per_task`` rows,
    where a row becomes ``rows`` of them.

    A few hundred thousand lines are one small file and hence one task, and adaptive execution sizes partitions by the
    bytes before the growth. Computes ``df`` once more, for the sum.
    """
    rows = F.lit(rows) if isinstance(rows, int) else rows
    total = df.agg(F.sum(rows.cast("double")).alias("n")).first()["n"] or 0.0
    return df.repartition(max(1, math.ceil(total / per_task)), *by)
