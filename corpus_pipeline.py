"""A corpus pipeline of five training-data operators; each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapengine.llm import common, decontaminate, jaccard_join, mixing, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score 0.3 or more go; learned from the labelled rows among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of exact and near copies stays."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that repeat a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sources are mixed to their target weights and shuffled; a document may stand more than once, or not at all."""
    return mixing.mixed(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every row gets a shard and a slot."""
    return sharding.sharded(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.col("tokens"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_copies), ("decontaminate", drop_leaks), ("mix_sources", mix), ("vector_shards", shard)]

#: Trained scores and greedy packing can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents one after another. A stage's table goes when the next one is written; the last one stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            common.removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
