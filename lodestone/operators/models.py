"""Embedders and pair scorers behind two small protocols; models run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EmbeddingConfig, RerankerConfig
from .sparse import WORD

EMBEDDED = "dense array<float>, sparse map<string, double>, vecs array<array<float>>"
#: Fixed: the names under which models give each output; the first that is there counts.
OUTPUTS = {"dense": ("dense_vecs", "dense_embeddings", "dense"), "sparse": ("sparse_vecs", "lexical_weights", "sparse"), "vecs": ("colbert_vecs", "colbert_embeddings", "colbert")}


class EmbeddingError(RuntimeError):
    """A model that gave no dense vectors, or fewer than it had texts."""


class Embedder(Protocol):
    def embed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The id column with dense, sparse (token to weight) and vecs (one vector for each token)."""


class Scorer(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """The pairs (qid, query, chunk_id, text) with rerank_score."""


def with_embeddings(embedder: Embedder, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with dense, sparse and vecs: beside their columns where the embedder can give them so (`attached`), so that
    no row is dealt by its id; else joined by id."""
    attached = getattr(embedder, "attached", None)
    return attached(texts, text_col) if attached else texts.join(embedder.embed(texts, id_col, text_col), id_col)


def given_beside(embedder: Embedder) -> bool:
    """Whether `with_embeddings` only adds columns to the rows: cheap expressions, to be computed again for each reader that
    needs one of them. Else a model is asked, and its outputs are to be kept."""
    return getattr(embedder, "attached", None) is not None


class PrecomputedEmbedder:
    """Outputs that stand in a table already, under the same id column."""

    def __init__(self, outputs: DataFrame) -> None:
        self.outputs = outputs

    def embed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return texts.select(id_col).join(self.outputs, id_col).select(id_col, "dense", "sparse", "vecs")


class LexicalEmbedder:
    """A deterministic stand-in without a model: word counts, and vectors made of hashed words. Its scores are not a
    model's. Each word of the whole text has its vector. All in SQL expressions."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return self.attached(texts.select(id_col, text_col), text_col).select(id_col, "dense", "sparse", "vecs")

    def attached(self, texts: DataFrame, text_col: str) -> DataFrame:
        """The rows with dense, sparse and vecs beside their columns."""
        d, given = self.dimension, [F.struct(*texts.columns).alias("_row")]
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
        split = texts.select(*given, words.alias("words"))
        # Equal words and equal cells lie together when sorted: a run's length is the difference of two starts.
        cells = F.expr(f"array_sort(transform(words, w -> CAST(pmod(xxhash64(w), {d}) AS int)))")
        ordered = split.select("_row", "words", F.array_sort("words").alias("a"), cells.alias("c"))
        starts = "filter(sequence(0, size(words)), i -> i < size(words) AND (i = 0 OR {0}[i] <> get({0}, i - 1)))"
        begun = ordered.select("*", F.expr(starts.format("a")).alias("a0"), F.expr(starts.format("c")).alias("c0"))
        runs = "map_from_arrays(transform({0}0, i -> {0}[i]), transform({0}0, (i, k) -> CAST(coalesce(get({0}0, k + 1), size(words)) - i AS double)))"
        counted = begun.select("_row", "words", F.expr(runs.format("a")).alias("sparse"), F.expr(runs.format("c")).alias("cells"))
        normed = counted.withColumn("norm", F.expr("sqrt(aggregate(map_values(cells), 0D, (s, x) -> s + x * x))"))
        dense = F.expr(f"transform(sequence(0, {d - 1}), c -> CAST(IF(norm > 0, coalesce(try_element_at(cells, c), 0D) / norm, 0D) AS float))")
        sparse = F.col("sparse")
        vecs = F.expr("transform(words, w -> transform(sequence(0, 7), i -> CAST(pmod(xxhash64(w, i), 2001) / 1000.0D - 1 AS float)))")
        return normed.select("_row.*", dense.alias("dense"), sparse.alias("sparse"), vecs.alias("vecs"))


def pick(outputs: Mapping[str, Any], names: Sequence[str], default: list[Any]) -> list[Any]:
    """What a model gave under one of the names, a value for each text; an output that isn't a sequence is an error."""
    given = next((outputs[name] for name in names if name in outputs), default)
    if not isinstance(given, (list, tuple, np.ndarray)):
        raise EmbeddingError(f"a model's {names[0]} must be a sequence, not {type(given).__name__}")
    return list(given)


class ModelEmbedder:
    """A model with encode(texts, batch_size, max_length, return_dense, return_sparse, return_colbert_vecs) -> mapping.

    The factory runs once in each Python worker, on first use; texts go in batches of batch_size.
    """

    def __init__(self, factory: Callable[[], Any], batch_size: int = 8, max_length: int = 8192) -> None:
        self.factory, self.batch_size, self.max_length = factory, max(1, batch_size), max_length

    def embed(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        factory, size, most = self.factory, self.batch_size, self.max_length

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                for a in range(0, len(frame), size):
                    part = frame.iloc[a : a + size]
                    model = model or factory()
                    batch = part[text_col].fillna("").tolist()
                    out = model.encode(batch, batch_size=len(batch), max_length=most, return_dense=True, return_sparse=True, return_colbert_vecs=True)
                    dense = pick(out, OUTPUTS["dense"], [])
                    if len(dense) != len(batch):
                        raise EmbeddingError(f"{len(dense)} dense vectors for {len(batch)} texts")
                    sparse = pick(out, OUTPUTS["sparse"], [{}] * len(batch))
                    vecs = pick(out, OUTPUTS["vecs"], [[]] * len(batch))
                    yield pd.DataFrame({
                        id_col: part[id_col].tolist(), "dense": [np.asarray(v, dtype=np.float32).tolist() for v in dense],
                        "sparse": [{str(k): float(w) for k, w in m.items()} for m in sparse], "vecs": [np.asarray(v, dtype=np.float32).tolist() for v in vecs],
                    })

        kind = dict(texts.dtypes)[id_col]
        return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, {EMBEDDED}")


class LexicalScorer:
    """A deterministic stand-in without a model: the share of the query's distinct words that the text has."""

    def score(self, pairs: DataFrame) -> DataFrame:
        def words(c: str):
            return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(f"({WORD})"), F.lit(1)))

        split = pairs.select("*", words("query").alias("_q"), words("text").alias("_d"))
        share = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_d")).cast("double") / F.size("_q")).otherwise(F.lit(0.0))
        return split.withColumn("rerank_score", F.round(share, 6)).drop("_q", "_d")


class ModelScorer:
    """A model with compute_score(pairs, normalize=True) -> scores, made once in each Python worker."""

    def __init__(self, factory: Callable[[], Any]) -> None:
        self.factory = factory

    def score(self, pairs: DataFrame) -> DataFrame:
        factory = self.factory

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                if len(frame):
                    model = model or factory()
                    scores = model.compute_score(frame[["query", "text"]].fillna("").values.tolist(), normalize=True)
                    yield frame.assign(rerank_score=np.atleast_1d(np.asarray(scores, dtype=float)))

        schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
        return pairs.mapInPandas(run, f"{schema}, rerank_score double")


def embedder_of(config: EmbeddingConfig, factory: Callable[[EmbeddingConfig], Any] | None = None) -> Embedder:
    """The embedder that the settings name: the stand-in for "lexical", else a model that `factory` makes of them in each
    Python worker (by default of the library that such models come with, which must be installed there)."""
    if config.model_name == "lexical":
        return LexicalEmbedder(config.dimension)
    make = factory or _flag_embedder
    return ModelEmbedder(lambda: make(config), config.batch_size, config.max_length)


def scorer_of(config: RerankerConfig, factory: Callable[[RerankerConfig], Any] | None = None) -> Scorer:
    """The pair scorer that the settings name; see `embedder_of`."""
    if config.model_name == "lexical":
        return LexicalScorer()
    make = factory or _flag_scorer
    return ModelScorer(lambda: make(config))


def _flag_embedder(config: EmbeddingConfig) -> Any:
    from FlagEmbedding import BGEM3FlagModel

    return BGEM3FlagModel(config.model_name, use_fp16=config.use_fp16, devices=config.device)


def _flag_scorer(config: RerankerConfig) -> Any:
    from FlagEmbedding import FlagReranker

    return FlagReranker(config.model_name, use_fp16=config.use_fp16)


def token_strings(ids: DataFrame, vocabulary: DataFrame, id_col: str = "token_id") -> DataFrame:
    """Token ids with their strings, looked up in a vocabulary table (token_id, token); unknown ids give null."""
    return ids.join(vocabulary.select(F.col("token_id").alias(id_col), "token"), id_col, "left")
