"""Registry of queries: name → (inventory ids, Spark plan, checking SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables, duck


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, **extra: str):
    """Register ``f(tables) -> DataFrame`` under its own name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = Query(
            ids, lambda spark, sf_dir: f(Tables(spark, sf_dir)), duck(sql, **extra) if sql else None
        )
        return f

    return register


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles before the comparison; all of them unless named."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})
