"""Reciprocal rank fusion and reranking of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import maxsim


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked.where(F.col("rank") <= max(k, 0))


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """qid, chunk_id, rrf (sum of 1 / (k + rank), nine decimals), dense_rank, sparse_rank, rank of two ranked lists.

    Ties keep the order in which a reader of the dense and then the sparse list would meet the chunks.
    """
    legs = dense.select("qid", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    legs = legs.unionByName(sparse.select("qid", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank")))
    share = F.sum(F.lit(1).cast("double") / (F.lit(k) + F.coalesce("dense_rank", "sparse_rank")))
    fused = legs.groupBy("qid", "chunk_id").agg(F.round(share, 9).alias("rrf"), F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    order = (F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    if top_k is None:
        return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return _top(fused, top_k, *order)


def gathered(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """The fused rows with the columns of their chunks; only these few rows meet the texts."""
    return fused.join(chunks, "chunk_id")


def colbert_rerank(candidates: DataFrame, queries: DataFrame, store: DataFrame, top_k: int) -> DataFrame:
    """qid, chunk_id, score and rank after late interaction of the candidates (qid, chunk_id, rank).

    queries: qid, vecs; store: chunk_id, vecs. The first 2 * top_k candidates are scored. Those without vectors are
    dropped, but where a query has none with vectors its candidates stay as they are (score null).
    """
    few = candidates.where(F.col("rank") <= 2 * max(top_k, 0)).select("qid", "chunk_id", F.col("rank").alias("old_rank"))
    with_q = few.join(queries.select("qid", F.col("vecs").alias("q_vecs")), "qid", "left")
    paired = with_q.join(store.select("chunk_id", F.col("vecs").alias("d_vecs")), "chunk_id", "left")
    scored = paired.select("qid", "chunk_id", "old_rank", F.when(F.col("d_vecs").isNotNull(), F.round(maxsim("q_vecs", "d_vecs"), 6)).alias("score"))
    any_scored = F.max(F.col("score").isNotNull().cast("int")).over(Window.partitionBy("qid"))
    kept = scored.withColumn("_any", any_scored).where(F.col("score").isNotNull() | (F.col("_any") == 0))
    return _top(kept, top_k, F.desc_nulls_last("score"), F.when(F.col("score").isNull(), F.col("old_rank")), "chunk_id").select("qid", "chunk_id", "score", "rank")


def reranked(scored: DataFrame, top_k: int) -> DataFrame:
    """The top_k of scored pairs (qid, chunk_id, rerank_score), ranked; ties go by id."""
    return _top(scored, top_k, F.desc("rerank_score"), "chunk_id")
