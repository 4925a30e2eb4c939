"""From raw documents to a sharded training mix, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenscribe.llm import decontam, mixing, near_dup, sharding, toxicity
from lumenscribe.session import run_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones, does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's token budget."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with slot and shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
#: A trained network and its rounding can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs, home = table(spark, sf_dir, "documents"), run_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{home}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
