"""Training-corpus pipeline over ``documents``; each stage applies one operator of ``tidewater.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import stages
from tidewater.llm.common import shared_dir

STAGES = [
    ("quality", stages.quality_rules),
    ("near", stages.near_duplicates),
    ("passages", stages.repeated_passages),
    ("benchmark", stages.decontaminated),
    ("bpe", stages.byte_bpe),
]

# Learned rules and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
