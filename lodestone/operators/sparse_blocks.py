"""Exact sparse search of many queries at once: blocks of queries against blocks of chunks, as in `dense`.

Chunks are dealt by their id once, with no more than the tokens that are asked; every task scores whole blocks by a matrix
product over the tokens that both sides have, and sends only its own top_k for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .dense import MERGES

#: Fixed: what counts as a word, in lower-cased texts.
WORD = r"[\p{L}\p{N}_]+"

#: Rows of a block at most, of chunks and of queries, and its entries at most (one row may have more). Each pair of blocks
#: is a row that goes to Python, so few large blocks cost less than many small ones.
BLOCK_CHUNKS, BLOCK_QUERIES, BLOCK_ENTRIES = 1024, 2048, 1 << 18
#: Tokens that one dense product goes over, pairs that are added at a time, and how many additions of a dense product cost
#: as much as one pair.
STEP, PAIRS, DENSE = 2048, 1 << 22, 512


def _packed(rows: DataFrame, id_col: str, prefix: str, most: int) -> DataFrame:
    """Blocks of rows (id, tokens, weights): columns {prefix}ids, {prefix}words (distinct ones), and of each entry {prefix}row,
    {prefix}code (its word's place) and {prefix}weight."""
    names = [f"{prefix}{n}" for n in ("ids", "words", "row", "code", "weight")]
    kind = dict(rows.dtypes)[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            weights = batch.column(2)
            shift = weights.offsets.to_numpy()[0] - ends[0]
            at, total = 0, batch.num_rows
            while at < total:
                n = int(np.searchsorted(ends[at + 1 :], ends[at] + BLOCK_ENTRIES, side="right"))
                n = min(max(n, 1), most, total - at)
                a, b = ends[at], ends[at + n]
                coded = batch.column(1).values[a:b].cast(pa.string()).dictionary_encode()
                row = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends[at : at + n + 1]))
                parts = [batch.column(0).slice(at, n), coded.dictionary, pa.array(row), pa.array(coded.indices.to_numpy().astype(np.int32)), weights.values[a + shift : b + shift]]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in parts], names=names)
                at += n

    return rows.mapInArrow(pack, f"{names[0]} array<{kind}>, {names[1]} array<string>, {names[2]} array<int>, {names[3]} array<int>, {names[4]} array<double>")


def _packed_texts(texts: DataFrame, most: int) -> DataFrame:
    """As `_packed`, of split texts (chunk_id, words): equal words of a text are one entry with their number as its weight."""
    names, kind = ("ids", "words", "row", "code", "weight"), dict(texts.dtypes)["chunk_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])
            at, total = 0, batch.num_rows
            while at < total:
                n = int(np.searchsorted(ends[at + 1 :], ends[at] + BLOCK_ENTRIES, side="right"))
                n = min(max(n, 1), most, total - at)
                coded = values[ends[at] : ends[at + n]].dictionary_encode()
                width = max(len(coded.dictionary), 1)
                cells, weights = np.unique(np.repeat(np.arange(n), sizes[at : at + n]) * width + coded.indices.to_numpy(), return_counts=True)
                parts = [batch.column(0).slice(at, n), coded.dictionary, pa.array((cells // width).astype(np.int32)), pa.array((cells % width).astype(np.int32)), pa.array(weights.astype(float))]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in parts], names=names)
                at += n

    return texts.select("chunk_id", "words").mapInArrow(pack, f"ids array<{kind}>, words array<string>, row array<int>, code array<int>, weight array<double>")


def placed_postings(texts: DataFrame) -> DataFrame:
    """chunk_id, token, weight and positions as `sparse.positioned_postings`, of chunks of one row each (chunk_id, text): made
    where the texts lie, with no shuffle."""
    kind = dict(texts.dtypes)["chunk_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = batch.column(1).flatten(), np.concatenate([[0], np.cumsum(sizes)])
            for a, b in _slices(ends[1:], BLOCK_ENTRIES):
                coded = values[ends[a] : ends[b]].dictionary_encode()
                width = max(len(coded.dictionary), 1)
                cells = np.repeat(np.arange(b - a), sizes[a:b]) * width + coded.indices.to_numpy()
                order = np.argsort(cells, kind="stable")
                first = np.flatnonzero(np.diff(cells[order], prepend=-1))
                found, bounds = cells[order][first], np.append(first, len(order))
                at = order - np.repeat(ends[a:b] - ends[a], sizes[a:b])[order]
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a).take(pa.array(found // width)), coded.dictionary.take(pa.array(found % width)), pa.array(np.diff(bounds).astype(float)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at.astype(np.int32)))],
                    names=["chunk_id", "token", "weight", "positions"],
                )

    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(f"({WORD})"), F.lit(1)).alias("words")
    return texts.select("chunk_id", words).mapInArrow(place, f"chunk_id {kind}, token string, weight double, positions array<int>")


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _entries(side: dict[str, pa.Array], places: np.ndarray) -> Entries:
    """Row, column and weight of the entries whose word has a place among the common ones (-1: none), by column."""
    column = places[side["code"].to_numpy()]
    kept = np.flatnonzero(column >= 0)
    kept = kept[np.argsort(column[kept], kind="stable")]
    return side["row"].to_numpy()[kept], column[kept], side["weight"].to_numpy()[kept]


def _scores(chunks: dict[str, pa.Array], queries: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The score of each query and chunk, and whether they share a token."""
    n_chunks, n_queries = len(chunks["ids"]), len(queries["ids"])
    found = pc.index_in(chunks["words"], value_set=queries["words"]).fill_null(-1).to_numpy().astype(np.int64)
    common = np.flatnonzero(found >= 0)
    in_chunks = np.full(len(chunks["words"]), -1)
    in_chunks[common] = np.arange(len(common))
    in_queries = np.full(len(queries["words"]), -1)
    in_queries[found[common]] = np.arange(len(common))
    c, q = _entries(chunks, in_chunks), _entries(queries, in_queries)
    score = _product(q, c, len(common), n_queries, n_chunks)
    if (c[2] > 0).all() and (q[2] > 0).all():
        return score, score > 0
    ones = [(row, column, np.ones(len(row))) for row, column, _ in (q, c)]
    return score, _product(*ones, len(common), n_queries, n_chunks) > 0.5


def _product(q: Entries, c: Entries, n_columns: int, n_queries: int, n_chunks: int) -> np.ndarray:
    """The sum over columns of the products of the queries' and the chunks' entries: columns with many pairs of entries go
    through dense products, STEP at a time, the pairs of the others are added one by one."""
    columns = np.arange(n_columns + 1)
    at_q, at_c = np.searchsorted(q[1], columns), np.searchsorted(c[1], columns)
    per_q, per_c = np.diff(at_q), np.diff(at_c)
    dense = per_q * per_c * DENSE > n_queries * n_chunks
    score = np.zeros((n_queries, n_chunks))
    chosen = np.flatnonzero(dense)
    place = np.full(n_columns, -1)
    place[chosen] = np.arange(len(chosen))
    for first in range(0, len(chosen), STEP):
        width = min(STEP, len(chosen) - first)
        sides = []
        for (row, column, weight), n in ((q, n_queries), (c, n_chunks)):
            at = place[column] - first
            inside = np.flatnonzero((at >= 0) & (at < width))
            sides.append(np.bincount(row[inside] * width + at[inside], weight[inside], n * width).reshape(n, width))
        score += sides[0] @ sides[1].T
    # Each entry of a query meets the run of its column's entries of chunks.
    of_q = np.flatnonzero(~dense[q[1]])
    runs = per_c[q[1][of_q]]
    ends = np.cumsum(runs)
    for i, j in _slices(ends, PAIRS):
        some, many = of_q[i:j], runs[i:j]
        entry = np.repeat(at_c[q[1][some]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell = np.repeat(q[0][some] * np.int64(n_chunks), many) + c[0][entry]
        score += np.bincount(cell, np.repeat(q[2][some], many) * c[2][entry], n_queries * n_chunks).reshape(n_queries, n_chunks)
    return score


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes, given by their running sum, come to `most` together, or single ones."""
    i = 0
    while i < len(ends):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")), i + 1)
        yield i, j
        i = j


class _Best:
    """The top_k of one block of queries among the blocks of chunks seen so far."""

    def __init__(self, n_queries: int, top_k: int) -> None:
        self.n, self.top_k = n_queries, top_k
        self.floor = np.full(n_queries, -np.inf)
        self.row, self.score, self.found = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)

    def see(self, ids: np.ndarray, score: np.ndarray, shared: np.ndarray) -> None:
        if score.shape[1] >= self.top_k and np.isneginf(self.floor).any():
            rounded = np.where(shared, np.round(score, 6), -np.inf)
            self.floor = np.maximum(self.floor, np.partition(rounded, -self.top_k, axis=1)[:, -self.top_k])
        # Floors are rounded scores: only what may reach them by rounding is rounded.
        row, col = np.nonzero(shared & (score >= self.floor[:, None] - 1e-6))
        score = np.round(score[row, col], 6)
        kept = score >= self.floor[row]
        row, col, score = row[kept], col[kept], score[kept]
        row, score, found = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.found, ids[col]])
        if len(row) > len(self.row):
            order = np.lexsort((-score, row))
            row, score, found = row[order], score[order], found[order]
            first = np.searchsorted(row, np.arange(self.n))
            last = first + self.top_k - 1
            full = np.flatnonzero((last < len(row)) & (row[np.minimum(last, len(row) - 1)] == np.arange(self.n)))
            self.floor[full] = score[last[full]]
            # All that tie with the last one stay until the merge, which knows the order of ids.
            kept = score >= self.floor[row]
            row, score, found = row[kept], score[kept], found[kept]
            if len(row) > 4 * self.n * self.top_k:
                order = np.lexsort((found, -score, row))
                row, score, found = row[order], score[order], found[order]
                kept = np.arange(len(row)) - np.searchsorted(row, np.arange(self.n))[row] < self.top_k
                row, score, found = row[kept], score[kept], found[kept]
            self.row, self.score, self.found = row, score, found


def search_blocks(postings: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """qid, chunk_id, sparse_score (six decimals) and rank of the top_k chunks of each query; ties go by id.

    postings: chunk_id, token, weight; queries: qid, token, weight, the idf in it. Every block of queries meets every block
    of chunks: Spark broadcasts the queries' blocks if they prove small, else deals pairs of partitions. A task keeps no
    more than its own top_k for each query, and sends only those. In place of postings there may be split texts (chunk_id,
    words; see `sparse.split_texts`), for few queries: their blocks are made and met where the texts lie.
    """
    kind, q_kind = dict(postings.dtypes)["chunk_id"], dict(queries.dtypes)["qid"]
    if top_k <= 0:
        return postings.sparkSession.createDataFrame([], f"qid {q_kind}, chunk_id {kind}, sparse_score double, rank int")
    lists = [F.collect_list("token").alias("tokens"), F.collect_list("weight").alias("weights")]
    asked = queries.where("token IS NOT NULL AND weight IS NOT NULL").groupBy("qid").agg(*lists)
    asked = _packed(asked, "qid", "q_", BLOCK_QUERIES).withColumn("q_block", F.monotonically_increasing_id()).repartition("q_block")
    if "words" in postings.columns:
        pairs = _packed_texts(postings, BLOCK_CHUNKS).crossJoin(F.broadcast(asked))
    else:
        held = postings.where("token IS NOT NULL AND weight IS NOT NULL").groupBy("chunk_id").agg(*lists)
        # Blocks of chunks are dealt too: where pairs of partitions are dealt, each is read again, but not made again. Every
        # partition of theirs sends a top_k for each query, so they are few, whatever their size.
        parts = 2 * postings.sparkSession.sparkContext.defaultParallelism
        pairs = _packed(held, "chunk_id", "", BLOCK_CHUNKS).withColumn("block", F.monotonically_increasing_id()).repartition(parts, "block").crossJoin(asked)
    q_type, id_type = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(postings.schema["chunk_id"].dataType)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[list, _Best]] = {}
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                block = columns["q_block"][i].as_py()
                chunks, asking = ({n: columns[p + n][i].values for n in ("ids", "words", "row", "code", "weight")} for p in ("", "q_"))
                if block not in seen:
                    seen[block] = asking["ids"].to_pylist(), _Best(len(asking["ids"]), top_k)
                ids = np.empty(len(chunks["ids"]), dtype=object)
                ids[:] = chunks["ids"].to_pylist()
                seen[block][1].see(ids, *_scores(chunks, asking))
        for qids, one in seen.values():
            if len(one.row):
                yield pa.record_batch([pa.array([qids[r] for r in one.row.tolist()], q_type), pa.array(one.found.tolist(), id_type), pa.array(one.score)], names=["qid", "chunk_id", "sparse_score"])

    order = (F.desc("sparse_score"), "chunk_id")
    found = pairs.mapInArrow(best, f"qid {q_kind}, chunk_id {kind}, sparse_score double").withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    merged = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "_part").orderBy(*order))).where(F.col("rank") <= top_k).drop("rank", "_part")
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= top_k)
