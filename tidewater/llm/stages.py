"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents``.  Every row has its own
verdict, whatever its id: quality and benchmark verdicts follow from the text, so
they travel by the text's digest; near-duplicates by id and digest, where rows
without id are kept.  What is left out is written and anti-joined, broadcast only
when small.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from tidewater.llm.common import materialised, ship, text_or_empty, when_small
from tidewater.llm.queries import RANKS

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


TEXT = "__text_digest"
NEAR_PERCENT = 80  # shingles that near-duplicates share at least
NEAR_TREES = 32  # miss a pair at that similarity with a probability of 6e-5 at the greatest depth


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(TEXT, F.md5(text_or_empty("text")))


def without(docs: DataFrame, rows: DataFrame, on: list[str], label: str) -> DataFrame:
    """``named`` documents that are not among ``rows``."""
    out = materialised(rows.select(*on).distinct(), label)
    return docs.join(when_small(out), on, "left_anti").select(*DOCUMENT)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learnt rules reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = named(docs)
    rows, _ = quality.decided(docs, labels, carry=(TEXT,))
    return without(docs, rows.where(~F.col("kept")), [TEXT], "pipeline-rejected")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = NEAR_PERCENT, trees: int = NEAR_TREES
) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    ship(spark)
    docs = named(docs)
    groups = near_dedup.grouped(docs, percent=percent, trees=trees, carry=TEXT)
    return without(docs, groups.where(~F.col("kept")), ["doc_id", TEXT], "pipeline-near-removed")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that start earlier; characters stay whole."""
    ship(spark)
    out = suffix_dedup.deduplicated(docs.select(*DOCUMENT), whole_characters=True)
    kept = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    out = out.withColumn("text", kept).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*DOCUMENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    docs = named(docs)
    rows = decontaminate.matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=TEXT)
    return without(docs, rows.where(decontaminate.contaminated()), [TEXT], "pipeline-contaminated")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the digest of the decoded bytes."""
    ship(spark)
    ranks = public_tokenizers.path(RANKS)
    coded = bpe.round_trip(spark, ranks, public_tokenizers.PATTERN, "text").alias("coded")
    out = docs.select("doc_id", "lang", "source", coded)
    digest = F.sha2("coded.decoded", 256).alias("decoded_sha256")
    return out.select("doc_id", "lang", "source", "coded.n_tokens", "coded.ids", digest)
