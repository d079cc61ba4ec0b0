"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing,
encoding.  Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame
that is written as Parquet and read again as the next stage's ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.bpe import bpe_stage
from riskspark.llm.minhash import dedup_stage
from riskspark.llm.mixing import mixing_stage
from riskspark.llm.shared import staged
from riskspark.llm.suffixes import repeats_stage
from riskspark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("repeated_passages", repeats_stage),
    ("mixing", mixing_stage),
    ("encoding", bpe_stage),
]

#: The stages learn models and solve for weights, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
