"""A corpus pipeline: toxic documents go, then those that fail the quality rules, then near-duplicates; the rest is packed.

Each stage's result is written as Parquet and read again as the next stage's documents; the tables of the first stages are deleted once the
next is written, the last one's when the driver ends.

Null texts count as empty: no stage fails on them, the quality rules drop them. Very long texts are taken whole. Rows that repeat, and
null ids, are judged one by one; the near-duplicate stage keeps one row of each group. Empty tables give no pieces. Extra columns, whatever their
names, are carried as far as the packing. Without labels no document is toxic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoquilt.llm import packing, quality_rules, simhash, toxicity
from orthoquilt.llm.common import delete, gone_at_exit, shared_dir, table, tokenizer_file


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.kept_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stay, in their sequences."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        else:
            gone_at_exit(spark, where)
        before = path
    return docs
