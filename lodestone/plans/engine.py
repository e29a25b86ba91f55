"""One object that wires a store, an embedder, a scorer and the settings, for callers with single queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.models import Embedder, Scorer, embedder_of, scorer_of
from ..sources import markdown
from . import ingest, retrieval


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Embedder | None = None, scorer: Scorer | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings.from_env()
        self.embedder, self.scorer = embedder or embedder_of(self.settings.embedding), scorer or scorer_of(self.settings.reranker)
        self.store = ingest.open_store(spark, self.settings.paths.vectordb_path)

    def ingest(self, source: str | None = None, force: bool = False) -> ingest.IngestionStats:
        return ingest.ingest_full(self.spark, self.store, source or self.settings.paths.knowledge_base_path, self.embedder, force, self.settings.chunker.max_chunk_tokens)

    def queries(self, rows: DataFrame) -> retrieval.Queries:
        """Embedded queries of rows (qid, text)."""
        embedded = self.embedder.embed(rows, "qid", "text")
        tokens = embedded.select("qid", F.explode("sparse").alias("token", "weight"))
        return retrieval.Queries(rows.join(embedded.select("qid", "dense", "vecs"), "qid"), tokens)

    def one(self, text: str) -> retrieval.Queries:
        return self.queries(self.spark.createDataFrame([(0, text)], "qid long, text string"))

    def _shown(self, found: DataFrame, index: retrieval.Index, score: str = "score") -> DataFrame:
        return retrieval.with_chunks(found.withColumnRenamed(score, "score"), index).orderBy("qid", "rank")

    def search(self, text: str, top_k: int = 10, filters: dict[str, str] | None = None, use_colbert_rerank: bool = False) -> DataFrame:
        index = ingest.open_index(self.store)
        return self._shown(retrieval.hybrid(index, self.one(text), top_k, filters, use_colbert_rerank, self.settings.retrieval), index)

    def search_documentation(self, text: str, domain: str | None = None, top_k: int = 5) -> DataFrame:
        index = ingest.open_index(self.store)
        return self._shown(retrieval.search_documentation(index, self.one(text), domain, top_k, self.scorer, self.settings.retrieval), index, "rerank_score")

    def search_code_examples(self, text: str, language: str | None = None, top_k: int = 5) -> DataFrame:
        index = ingest.open_index(self.store)
        return self._shown(retrieval.search_code_examples(index, self.one(text), language, top_k, self.scorer, self.settings.retrieval), index, "rerank_score")

    def lookup_define(self, name: str, category: str | None = None, top_k: int = 5) -> DataFrame:
        index = ingest.open_index(self.store)
        return self._shown(retrieval.lookup_define(index, self.one(name if category is None else f"{category} {name}"), top_k, config=self.settings.retrieval), index)

    def lookup_modifier(self, name: str, category: str | None = None, top_k: int = 5) -> DataFrame:
        index = ingest.open_index(self.store)
        return self._shown(retrieval.lookup_modifier(index, self.one(name if category is None else f"{category} {name}"), top_k, config=self.settings.retrieval), index)

    def diagnose_error(self, message: str, context: str | None = None, top_k: int = 5) -> DataFrame:
        index = ingest.open_index(self.store)
        return self._shown(retrieval.diagnose_error(index, self.one(f"{message}\n{context}" if context else message), top_k, self.settings.retrieval), index)

    def get_document_section(self, chunk_id: str, include_context: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """The section's row (none if unknown), and with context the sections of its file."""
        chunks = self.store.read("chunks")
        section = retrieval.get_section(chunks, chunk_id, "id").drop("dense_vector", "token_count", "content_hash", "ingestion_timestamp")
        if not include_context:
            return section, None
        return section, retrieval.section_siblings(chunks, chunk_id, "id").select("id", "text", "section_heading", "section_anchor").orderBy("id")

    def list_domains(self) -> DataFrame:
        return markdown.list_domains(self.spark, self.settings.paths.knowledge_base_path)

    def domain_overview(self, name: str) -> str | None:
        return markdown.domain_overview(self.spark, self.settings.paths.knowledge_base_path, name)

    def stats(self) -> int:
        return ingest.table_stats(self.store).first()[0]

    def score_pair(self, query: str, text: str) -> float:
        pair = self.spark.createDataFrame([(0, query, "0", text)], "qid long, query string, chunk_id string, text string")
        return float(self.scorer.score(pair).first()["rerank_score"])
