"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. quality: documents that the classifier rejects go,
2. near_duplicates: one document of each group of linked ones stays,
3. substrings: repeated passages are cut out; a document without any words left goes,
4. mixture: sources are taken to target weights, some documents twice, some in part, some not,
5. packing: what is left is tokenized and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firegrid.llm import jaccard, mixing, packing, quality, substring
from firegrid.llm.common import Scratch
from firegrid.llm.queries import table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_component(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixture", mix),
    ("packing", pack),
]

# A learned classifier and a tokenizer are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.store(stage(spark, docs, sf_dir), f"{number}_{name}")
    return docs
