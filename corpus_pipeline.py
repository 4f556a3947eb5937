"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept and returns a DataFrame. ``run`` writes each but the
last stage's rows as Parquet to the folder that the cluster shares for checkpoints, so that a
lost executor costs one stage at most, and reads them again for the next. The last of these is
read when the result is, so the folder stays; who owns the shared folder clears it.

An empty table passes through all stages; rows with a null ``doc_id`` are documents like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, quality_rules, sharding, simhash
from tessera.llm.common import table
from tessera.operators.storage import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply_quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item lies."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    placed = sharding.shard_rows(docs)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mix),
    ("sharding", shards),
]

#: SQL has neither the fingerprints nor the permutation; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(kept)
        docs = spark.read.parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
