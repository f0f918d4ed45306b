"""From raw documents to training shards: five stages, each one corpus operator.

Every stage reads what the one before wrote, as Parquet in the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a part of one stage. A stage's decisions take effect: rejected,
duplicate and leaked documents go, documents that the mix takes twice come twice, and one it leaves out goes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, importance, mix_sources, near_copies, sharding
from textloom.llm._common import documents, shared_folder

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels keeps."""
    return importance.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash (two bits) or similarity (five-word shingles, Jaccard 0.8 or more)."""
    return near_copies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a confirmed overlap with a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shuffle_into_shards(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", shard)]

#: SQL can't express the hash models and permutations of the stages; tests hold each stage, on its own input, against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's table goes once the next one is written; the last one's stays, as the result."""
    docs, top, last = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            _drop(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
