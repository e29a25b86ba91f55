"""The jobs as registered queries: each is run twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_documents, publish_passages
from lodestone.plans.queries import ORACLES as LIBRARY_SQL
from lodestone.plans.queries import SPLIT_SQL, scratch

MAX_TOKENS = 60


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental index of all documents."""
    folder = scratch(spark, "index-documents")
    for _ in range(2):
        index_documents.update_index(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return index_documents.open_index(spark, f"{folder}/index").scored().withColumn("idf", F.round("idf", 9))


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents, each with what the catalogue says of its domain."""
    folder = scratch(spark, "publish-passages")
    for _ in range(2):
        publish_passages.publish(spark, f"{sf_dir}/documents.parquet", folder, {"max_tokens": MAX_TOKENS})
    listed = publish_passages.read_catalogue(spark, folder).select("domain", *[F.col(c).alias(f"domain_{c}") for c in ("documents", "passages", "tokens")])
    return publish_passages.read_passages(spark, folder).join(F.broadcast(listed), "domain")


QUERIES = {"job1_index_documents": job1, "job2_publish_passages": job2}
ORACLES = {
    "job1_index_documents": LIBRARY_SQL["idf_scores"].rpartition("SELECT")[0] + "SELECT chunk_id, token, weight, df, round(idf, 9) AS idf FROM postings JOIN idf USING (token)",
    "job2_publish_passages": f"""
WITH {SPLIT_SQL}, passages AS (
  SELECT doc_id || '#' || part_no AS id, doc_id, part_no, source AS concept, part AS passage, CAST(greatest(1, length(part) // 4) AS BIGINT) AS token_count, sha256(part) AS content_hash, coalesce(nullif(lang, ''), 'unknown') AS domain
  FROM split JOIN documents USING (doc_id)
), catalogue AS (
  SELECT domain, count(DISTINCT doc_id) AS domain_documents, count(*) AS domain_passages, CAST(sum(token_count) AS BIGINT) AS domain_tokens FROM passages GROUP BY domain
)
SELECT * FROM passages JOIN catalogue USING (domain)""",
}
