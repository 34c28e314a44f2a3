"""The corpus pipeline: documents to shards in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import common, pipeline

STAGES = [
    ("language_id", pipeline.language),
    ("near_duplicates", pipeline.near_duplicates),
    ("decontamination", pipeline.decontaminate),
    ("mixing", pipeline.mix),
    ("sharding", pipeline.shard),
]

#: SQL can express neither the language model nor the draws' hashes; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
