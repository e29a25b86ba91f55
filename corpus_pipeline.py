"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, pseudonyms, packing; one operator each.

Each stage takes all rows that its predecessor kept and returns the columns of documents (the last one: pieces). Null
and empty texts fail the first stage's least number of words. Rows with a null doc_id, repeated rows and empty tables
go through as each operator says. Columns beyond those of documents are carried along. Many small input files become
fewer tasks and fewer output files (`compacted`).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, near_dedup, packing, pii, quality_rules
from lodestone.llm._common import compacted, small_batches, staged
from lodestone.llm.queries import PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy web-1 rejects."""
    return quality_rules.kept_rows(compacted(docs), "web-1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.deduplicated(docs, near_dedup.Spec(width=5, percent=80))


def _a_few_at_a_time(df: DataFrame, name: str) -> DataFrame:
    """The rows, staged while texts go to Python in batches of a few MB: workers live on from stage to stage, and so does
    the memory that large batches have taken."""
    with small_batches(df.sparkSession):
        return staged(df, f"pipeline-{name}")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return _a_few_at_a_time(decontamination.decontaminate(compacted(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "benchmark")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in place of private numbers, dates and names of mail accounts."""
    return pii.pseudonymised_rows(compacted(docs), PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of power-of-two lengths with their ids."""
    return _a_few_at_a_time(packing.pack(compacted(docs), public_tokenizers.path("byte_bpe_50k.json")), "packed")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("private", private), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        docs = rows if hasattr(rows, "_lodestone_path") else staged(rows, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
