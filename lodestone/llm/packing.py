"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_and_text
from .tokens import byte_bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"


def binary_lengths(n: int, top: int) -> list[int]:
    """The piece lengths of a document of n ids: as many of `top` as fit, then the binary digits of the rest, falling.

    >>> binary_lengths(2048 + 13, 2048)
    [2048, 8, 4, 1]
    """
    rest = n % top
    return [top] * (n // top) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def power_of_two_pieces(df: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32-bit) and its bucket, the log2 of its length.

    A narrow map without any shuffle; rows are cut one document at a time, so memory holds one batch of texts and the
    ids of one document. A null or empty text is the end id alone, one piece of length 1. A null doc_id stays null;
    repeated rows are separate documents. An empty table gives no rows. Other columns are not read.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(tokenizer_path), np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([bpe.ids(text.as_py() or ""), end]).astype("<u4", copy=False)
                raw, at = memoryview(ids.tobytes()), 0
                for n in binary_lengths(len(ids), max_length):
                    piece = raw[4 * at : 4 * (at + n)]
                    for column, value in zip(out, (doc, at, n, zlib.crc32(piece), len(ids), n.bit_length() - 1, bytes(piece))):
                        column.append(value)
                    at, size = at + n, size + 4 * n
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [[] for _ in range(7)], 0
            yield _batch(out)

    return key_and_text(df, id_col, text_col).mapInArrow(cut, PIECES)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"])


def pack(df: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences: every piece is a sequence of its own, full at its power of two, so padding and crossing are nil.

    `sequence_id` is unique and follows the input's order; `bucket` groups the sequences of equal length, from which a
    loader draws batches (see `write_buckets`). Nulls, empty texts and repeated rows as in `power_of_two_pieces`.
    """
    return power_of_two_pieces(df, tokenizer_path, max_length, end_id, id_col, text_col).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each bucket of equal lengths; its files have rows of one shape. Rows are dealt by bucket, and a bucket
    that many rows share is split over tasks."""
    packed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
