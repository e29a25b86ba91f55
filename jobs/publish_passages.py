"""Cut a table of documents into passages that fit a model's window, and publish them by domain with a catalogue.

    python -m jobs.publish_passages DOCUMENTS TARGET [--config FILE]

DOCUMENTS is a Parquet file or folder. Under TARGET the job leaves

- passages (Parquet, one folder for each domain): id, doc_id, part_no, concept, passage, token_count, content_hash;
- catalogue (JSON, one row for each domain): domain, documents, passages, tokens.

Passages are whole paragraphs, or runs of whole sentences of paragraphs that are too long. With `domains` in the settings
only these are made anew (by dynamic partition overwrite) and others stay as they are; without, all are replaced. The
catalogue follows from all passages that stand there then. The cutting is a narrow map: no shuffle, whatever share of
the rows one domain has. A run that failed is mended by running it again: the same input gives the same output.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from lodestone.functions.text import chunk_id, content_hash, token_estimate
from lodestone.operators.chunker import split_paragraphs

DEFAULTS: dict[str, Any] = {"id_column": "doc_id", "text_column": "text", "domain_column": "lang", "concept_column": "source", "max_tokens": 1500, "domains": [], "rows_per_file": 1_000_000}
#: The domain of documents that have none.
NO_DOMAIN = "unknown"
PASSAGES = "id string, doc_id {}, part_no int, concept string, passage string, token_count long, content_hash string, domain string"
CATALOGUE = "domain string, documents long, passages long, tokens long"


def passages_of(documents: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """The passages of documents; a null or blank text has none, rows of one id have theirs each."""
    s = settings
    domain = F.coalesce(F.nullif(F.col(s["domain_column"]).cast("string"), F.lit("")), F.lit(NO_DOMAIN))
    named = documents.select(F.col(s["id_column"]).alias("doc_id"), F.col(s["concept_column"]).cast("string").alias("concept"), F.col(s["text_column"]).alias("text"), domain.alias("domain"))
    if s["domains"]:
        named = named.where(F.col("domain").isin(list(s["domains"])))
    parts = split_paragraphs(named, s["max_tokens"]).withColumnRenamed("part", "passage")
    return parts.select(
        chunk_id(F.col("doc_id").cast("string"), F.col("part_no").cast("string")).alias("id"), "doc_id", "part_no", "concept", "passage",
        token_estimate(F.col("passage")).alias("token_count"), content_hash(F.col("passage")).alias("content_hash"), "domain",
    )


def read_passages(spark: SparkSession, target: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(PASSAGES.format(id_type)).parquet(f"{target.rstrip('/')}/passages")


def read_catalogue(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).json(f"{target.rstrip('/')}/catalogue")


def publish(spark: SparkSession, documents: str, target: str, settings: dict[str, Any] | None = None) -> dict[str, int]:
    """Write the passages and the catalogue, and return how many rows were read, written and listed."""
    s = {**DEFAULTS, **(settings or {})}
    target = target.rstrip("/")
    seen, made = Observation(), Observation()
    rows = spark.read.parquet(documents)
    id_type = rows.schema[s["id_column"]].dataType.simpleString()
    passages = passages_of(rows.observe(seen, F.count(F.lit(1)).alias("rows")), s).observe(made, F.count(F.lit(1)).alias("rows"))
    writer = passages.write.mode("overwrite").option("maxRecordsPerFile", s["rows_per_file"])
    # Only named domains: their folders alone are replaced. All of them: what the input no longer has goes too.
    writer.option("partitionOverwriteMode", "dynamic" if s["domains"] else "static").partitionBy("domain").parquet(f"{target}/passages")
    counted = read_passages(spark, target, id_type).groupBy("domain").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("passages"), F.sum("token_count").alias("tokens"))
    counted.coalesce(1).write.mode("overwrite").json(f"{target}/catalogue")
    counts = {"read": int(seen.get["rows"]), "written": int(made.get["rows"]), "domains": read_catalogue(spark, target).count()}
    log.info("%s to %s: %s", documents, target, counts)
    return counts


if __name__ == "__main__":
    command_line("publish_passages", ["documents", "target"], "publish_passages.json", DEFAULTS, publish)
