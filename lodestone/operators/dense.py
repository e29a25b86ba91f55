"""Exact nearest neighbours of many queries at once: blocks of queries against blocks of the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Numbers of a block of vectors (at most; one vector may be larger), and vectors.
BLOCK_NUMBERS, BLOCK_VECTORS = 1 << 18, 1024
#: Parts that the tasks' nearest are merged in before the last merge.
MERGES = 32


def equal_to(filters: Mapping[str, str] | None) -> Column:
    """All of the columns equal to their values; values are bound as literals."""
    return reduce(Column.__and__, (F.col(k) == F.lit(v) for k, v in (filters or {}).items()), F.lit(True))


def _packed(rows: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    """Blocks of the rows' vectors, as columns {prefix}ids, {prefix}dim and {prefix}flat; made where the rows are."""
    kind = dict(rows.dtypes)[id_col]
    names = [f"{prefix}ids", f"{prefix}dim", f"{prefix}flat"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            ends = vectors.offsets.to_numpy()
            sizes = np.diff(ends)
            at = 0
            while at < len(sizes):
                dim = int(sizes[at])
                # As far as the vectors are of one length.
                other = np.flatnonzero(sizes[at:] != dim)
                most = max(min(BLOCK_VECTORS, BLOCK_NUMBERS // max(dim, 1)), 1)
                n = min(most, int(other[0]) if len(other) else len(sizes) - at)
                flat = vectors.values[ends[at] : ends[at + n]]
                ids = batch.column(0).slice(at, n)
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n * dim], pa.int32()), flat.cast(pa.float64()))],
                    names=names,
                )
                at += n

    chosen = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(id_col, vector_col)
    return chosen.mapInArrow(pack, f"{names[0]} array<{kind}>, {names[1]} int, {names[2]} array<double>")


class _Nearest:
    """The top_k nearest of one block of queries among the blocks of vectors seen so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, top_k: int) -> None:
        self.ids, self.q, self.top_k = ids, q, top_k
        self.norms = (q * q).sum(axis=1)
        self.floor = np.full(len(q), np.inf)
        self.row, self.dist, self.found = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        norms = (x * x).sum(axis=1)
        about = norms[None] + self.norms[:, None] - 2 * self.q @ x.T
        if about.shape[1] >= self.top_k:
            self.floor = np.minimum(self.floor, np.partition(about, self.top_k - 1, axis=1)[:, self.top_k - 1])
        # The expansion only chooses: all that may belong to the nearest after rounding are measured directly.
        slack = 2e-6 + 1e-12 * (norms.max(initial=0) + self.norms)
        row, col = np.nonzero(about <= (self.floor + slack)[:, None])
        step = max(BLOCK_NUMBERS * 8 // max(x.shape[1], 1), 1)
        parts = [((self.q[row[i : i + step]] - x[col[i : i + step]]) ** 2).sum(axis=1) for i in range(0, len(row), step)]
        dist = np.round(np.concatenate([*parts, np.zeros(0)]), 6)
        row, dist, found = np.concatenate([self.row, row]), np.concatenate([self.dist, dist]), np.concatenate([self.found, ids[col]])
        order = np.lexsort((found, dist, row))
        row, dist, found = row[order], dist[order], found[order]
        first = np.searchsorted(row, np.arange(len(self.q)))
        place = np.arange(len(row)) - first[row]
        kept = place < self.top_k
        last = np.flatnonzero(place == self.top_k - 1)
        self.floor[row[last]] = np.minimum(self.floor[row[last]], dist[last])
        self.row, self.dist, self.found = row[kept], dist[kept], found[kept]


def search_dense(corpus: DataFrame, queries: DataFrame, top_k: int, filters: Mapping[str, str] | None = None, id_col: str = "chunk_id", vector_col: str = "dense_vector", qid_col: str = "qid", query_col: str = "dense") -> DataFrame:
    """qid, chunk id, dist (squared Euclidean, six decimals) and rank of the top_k nearest rows, filtered first.

    Corpus and queries are packed to blocks where they lie, and every block of queries meets every block of vectors: Spark
    broadcasts the queries' blocks if they prove small, else deals pairs of partitions. Nothing passes the driver and no
    job runs while the plan is made. Every task keeps its own top_k for each query and sends only those; they are merged
    in parts, and then the parts. Ties go by id. Rows or queries without an id or a vector take no part; vectors of
    another length than the query's are an error. top_k of 0 or less gives no rows.
    """
    kind, q_kind = dict(corpus.dtypes)[id_col], dict(queries.dtypes)[qid_col]
    if top_k <= 0:
        return corpus.sparkSession.createDataFrame([], f"qid {q_kind}, {id_col} {kind}, dist double, rank int")
    # Dealt by block, so that their size is known before they are joined.
    asked = _packed(queries, qid_col, query_col, "q_").withColumn("q_block", F.monotonically_increasing_id()).repartition("q_block")
    pairs = _packed(corpus.where(equal_to(filters)), id_col, vector_col, "").crossJoin(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, _Nearest] = {}
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                block, dim, q_dim = (columns[c][i].as_py() for c in ("q_block", "dim", "q_dim"))
                if dim != q_dim:
                    raise ValueError(f"vectors of length {dim} and queries of length {q_dim}")
                flat = {c: columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat", "q_ids", "q_flat")}
                if block not in seen:
                    seen[block] = _Nearest(flat["q_ids"], flat["q_flat"].reshape(len(flat["q_ids"]), dim), top_k)
                seen[block].see(flat["ids"], flat["flat"].reshape(len(flat["ids"]), dim))
        for one in seen.values():
            qids = pa.array(one.ids[one.row].tolist(), q_type) if len(one.row) else None
            if qids is not None:
                yield pa.record_batch([qids, pa.array(one.found.tolist(), id_type), pa.array(one.dist)], names=["qid", id_col, "dist"])

    q_type, id_type = to_arrow_type(queries.schema[qid_col].dataType), to_arrow_type(corpus.schema[id_col].dataType)
    order = ("dist", id_col)
    found = pairs.mapInArrow(nearest, f"qid {q_kind}, {id_col} {kind}, dist double").withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    merged = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "_part").orderBy(*order))).where(F.col("rank") <= top_k).drop("rank", "_part")
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= top_k)
