"""Retrieval plans over one index: hybrid search and the tools built on it. All take many queries at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..operators.dense import equal_to, search_dense
from ..operators.fusion import colbert_rerank, gathered, reranked, rrf
from ..operators.models import LexicalScorer, Scorer
from ..operators.sparse import search_sparse
from ..schemas import METADATA


@dataclass
class Index:
    """chunks: chunk_id, text, dense_vector and metadata columns; postings (or split texts) and idf: see operators.sparse;
    colbert: chunk_id, vecs, or None."""

    chunks: DataFrame
    postings: DataFrame
    idf: DataFrame
    colbert: DataFrame | None = None
    #: chunk_id of all chunks, where that is cheaper to read than from `chunks`.
    ids: DataFrame | None = None
    #: chunk_id, text and metadata of all chunks, where they lie apart from the vectors.
    texts: DataFrame | None = None


@dataclass
class Queries:
    """rows: qid, text, dense (and vecs for late interaction); tokens: qid, token, weight."""

    rows: DataFrame
    tokens: DataFrame


#: Found rows, by the number of queries, up to which they are sent to the texts, which then aren't shuffled.
MOST_FOUND = 1 << 15


def _sent(found: DataFrame, queries: Queries, per_query: int) -> DataFrame:
    most = MOST_FOUND // max(per_query, 1)
    return F.broadcast(found) if queries.rows.select("qid").limit(most + 1).count() <= most else found


def hybrid(index: Index, queries: Queries, top_k: int = 10, filters: Mapping[str, str] | None = None, use_colbert_rerank: bool = False, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """qid, chunk_id, score, rank of the fused dense and sparse legs; texts stay out of the plan (see `with_chunks`).

    Filters narrow the dense leg alone, unless the configuration says otherwise; in either leg they come before the cut.
    Sparse hits without a chunk are dropped after it.
    """
    dense = search_dense(index.chunks, queries.rows, config.top_k_dense, filters)
    allowed = index.chunks.where(equal_to(filters)) if config.filter_sparse and filters else None
    sparse = search_sparse(index.postings, index.idf, queries.tokens, config.top_k_sparse, chunks=index.chunks if index.ids is None else index.ids, allowed=allowed)
    fused = rrf(dense, sparse, config.rrf_k, max(top_k, 0))
    if use_colbert_rerank and index.colbert is not None:
        again = colbert_rerank(fused, queries.rows, index.colbert, top_k)
        return again.join(fused.select("qid", "chunk_id", "rrf"), ["qid", "chunk_id"]).select("qid", "chunk_id", F.coalesce("score", "rrf").alias("score"), "rank")
    return _sent(fused.select("qid", "chunk_id", F.col("rrf").alias("score"), "rank"), queries, top_k)


def with_chunks(found: DataFrame, index: Index) -> DataFrame:
    """qid, rank, chunk_id, text, score and the metadata map of found rows."""
    chunks = index.chunks if index.texts is None else index.texts
    meta = [c for c in METADATA if c in chunks.columns]
    pairs = [x for c in meta for x in (F.lit(c), F.col(c))]
    rows = gathered(found, chunks.select("chunk_id", "text", *meta))
    return rows.select("qid", "rank", "chunk_id", "text", "score", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string, string>")).alias("metadata"))


def search_and_rerank(index: Index, queries: Queries, top_k: int = 5, filters: Mapping[str, str] | None = None, scorer: Scorer | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """qid, chunk_id, rerank_score, rank: twice as many fused hits as wanted, scored as pairs and cut."""
    first = hybrid(index, queries, 2 * max(top_k, 0), filters, config=config)
    asked = _sent(first.select("qid", "chunk_id").join(queries.rows.select("qid", F.col("text").alias("query")), "qid"), queries, 2 * top_k)
    pairs = asked.join((index.chunks if index.texts is None else index.texts).select("chunk_id", "text"), "chunk_id")
    scored = (scorer or LexicalScorer()).score(pairs.select("qid", "query", "chunk_id", "text"))
    return reranked(scored.select("qid", "chunk_id", "rerank_score"), top_k)


def search_documentation(index: Index, queries: Queries, domain: str | None = None, top_k: int = 5, scorer: Scorer | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return search_and_rerank(index, queries, top_k, {"domain": domain} if domain else None, scorer, config)


def search_code_examples(index: Index, queries: Queries, language: str | None = None, top_k: int = 5, scorer: Scorer | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """As search_documentation without a domain; the language is accepted and not used."""
    return search_and_rerank(index, queries, top_k, None, scorer, config)


def lookup(index: Index, queries: Queries, domain: str, top_k: int = 5, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Hybrid search in one domain, without reranking: the plan of lookup_define and lookup_modifier."""
    return hybrid(index, queries, top_k, {"domain": domain}, config=config)


def lookup_define(index: Index, queries: Queries, top_k: int = 5, domain: str = "defines_list", config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return lookup(index, queries, domain, top_k, config)


def lookup_modifier(index: Index, queries: Queries, top_k: int = 5, domain: str = "modifiers_list", config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return lookup(index, queries, domain, top_k, config)


def diagnose_error(index: Index, queries: Queries, top_k: int = 5, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return hybrid(index, queries, top_k, config=config)


def lookup_text(rows: DataFrame) -> DataFrame:
    """qid and text "category name" (or the name alone) of rows (qid, name, category)."""
    return rows.select("qid", F.concat_ws(" ", "category", "name").alias("text"))


def error_text(rows: DataFrame) -> DataFrame:
    """qid and text of rows (qid, message, context): the message, and the context on the next line if there is one."""
    return rows.select("qid", F.when(F.coalesce("context", F.lit("")) == "", F.col("message")).otherwise(F.concat("message", F.lit("\n"), "context")).alias("text"))


def get_section(chunks: DataFrame, chunk_id: object, id_col: str = "chunk_id") -> DataFrame:
    """The chunk of that id, or no row."""
    return chunks.where(F.col(id_col) == F.lit(chunk_id)).limit(1)


def get_sections(chunks: DataFrame, asked: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The chunks of a table of ids, each id's once; an unknown or null id gives no row.

    Spark sends the asked ids to the scan of the chunks (as a broadcast while they are few, else as a Bloom filter before
    the shuffle), so a long table of chunks isn't sorted for a few ids.
    """
    return chunks.join(asked.select(id_col).distinct(), id_col, "left_semi").dropDuplicates([id_col])


def sections_with_context(chunks: DataFrame, asked: DataFrame, id_col: str = "chunk_id", file_col: str = "file_path") -> DataFrame:
    """asked_id and the chunks of the file of each asked id, itself included; two shuffles by file, no scan for each id.

    A file is as large as a document, so its sections are few; a null file has no siblings.
    """
    files = chunks.join(asked.select(id_col).distinct(), id_col, "left_semi").select(F.col(id_col).alias("asked_id"), F.col(file_col).alias("_file")).distinct()
    return files.join(chunks, F.col("_file") == F.col(file_col)).drop("_file")


def section_siblings(chunks: DataFrame, chunk_id: object, id_col: str = "chunk_id", file_col: str = "file_path") -> DataFrame:
    """All chunks of the same file as that chunk, itself included."""
    one = get_section(chunks, chunk_id, id_col).select(F.col(file_col).alias("_file"))
    return chunks.join(F.broadcast(one), F.col(file_col) == F.col("_file"), "left_semi")
