"""Settings, read from the environment by group prefix; every field has a default."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any


def _from_env(cls: type, prefix: str) -> Any:
    """An instance whose fields come from PREFIX_FIELD where such a variable is set."""
    read = {"int": int, "float": float, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "str": str}
    given = {f.name: read[str(f.type)](os.environ[name]) for f in fields(cls) if (name := f"{prefix}{f.name}".upper()) in os.environ}
    return cls(**given)


@dataclass(frozen=True)
class EmbeddingConfig:
    model_name: str = "lexical"
    use_fp16: bool = True
    device: str = "cpu"
    max_length: int = 8192
    batch_size: int = 8
    dimension: int = 1024


@dataclass(frozen=True)
class RerankerConfig:
    model_name: str = "lexical"
    use_fp16: bool = True
    #: Accepted and not read: callers give the number of results.
    top_k: int = 10


@dataclass(frozen=True)
class RetrievalConfig:
    top_k_dense: int = 50
    top_k_sparse: int = 50
    rrf_k: int = 60
    #: Accepted and not read: fusion is unweighted.
    dense_weight: float = 0.4
    sparse_weight: float = 0.2
    colbert_weight: float = 0.4
    #: Filters narrow the dense leg only; True narrows the sparse leg too.
    filter_sparse: bool = False


@dataclass(frozen=True)
class PathsConfig:
    knowledge_base_path: str = "knowledge_base"
    vectordb_path: str = "vectordb"
    model_cache_path: str = "models"


@dataclass(frozen=True)
class ChunkerConfig:
    max_chunk_tokens: int = 1500
    #: Accepted without effect, as sections are never merged, overlapped or cut inside.
    min_chunk_tokens: int = 100
    overlap_tokens: int = 0
    code_block_atomic: bool = True


@dataclass(frozen=True)
class Settings:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    reranker: RerankerConfig = field(default_factory=RerankerConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    paths: PathsConfig = field(default_factory=PathsConfig)
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    server_name: str = "lodestone"
    log_level: str = "INFO"
    debug: bool = False

    @classmethod
    def from_env(cls) -> Settings:
        return cls(_from_env(EmbeddingConfig, "EMBEDDING_"), _from_env(RerankerConfig, "RERANKER_"), _from_env(RetrievalConfig, "RETRIEVAL_"), _from_env(PathsConfig, ""), _from_env(ChunkerConfig, "CHUNKER_"))
