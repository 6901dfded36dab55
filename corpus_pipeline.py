"""A training corpus from raw documents, in five stages.

Each stage takes the table that the one before it wrote. Documents whose
language is unclear go; one document of each group of near copies stays; those
that hold a test item go; the rest are repeated or thinned out to the target
mix; and all are shuffled into shards.

Defined results. Rows whose text is null, empty or without letters go in the
first stage, as their language is unclear. A null doc_id is kept like any other
and comes after all others where one of a group is chosen; of rows that are
equal one stays. Ties between languages are unclear, ties between near copies
go to the smallest doc_id, then the text's hash. Very long texts are read whole.
Other columns, whatever their names, pass through all stages; `shard` and
`position` get an underscore if these names are taken. A table without rows
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, langid, mixing, sharding
from tessera.llm.cluster import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and position."""
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", target_mix),
    ("sharding", shards),
]

#: Trained classifiers, alignment and seeded shuffles are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
