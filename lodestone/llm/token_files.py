"""Token ids in Simple-8b: 64-bit words whose selectors say how many ids they hold, in blocks with offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_and_text, staged
from .tokens import byte_bpe

#: Fixed by the format: (bits of an id, ids in a word) of the selectors 1 to 15; selector 0 is an escape, whose id
#: (more than 60 bits) stands in the block's list of escapes.
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1), (0, 240))
BLOCK, MAGIC, HEADER = 1 << 16, b"LS8B", "<4sIQQQI"
#: File images in one Parquet file: about 15 MB.
IMAGES_A_FILE = 32
HELD = np.array([1, *(n for _, n in SELECTORS)], dtype=np.int64)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 61 stands for more than 60."""
    powers = np.uint64(1) << np.arange(61, dtype=np.uint64)
    if len(ids) and int(ids.max()) < 1 << 16:
        return np.searchsorted(powers, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)[ids]
    return np.searchsorted(powers, ids, side="right").astype(np.uint8)


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of up to BLOCK ids: each word takes as many of the next ids as any selector can hold."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, width = len(ids), _widths(ids)
    chosen = np.zeros(n, dtype=np.uint8)
    for code, (bits, held) in sorted(enumerate(SELECTORS, 1), key=lambda x: x[1][1]):
        # Runs of ids that are narrow enough; a word may be short only at the block's end.
        stops = np.flatnonzero(width > bits)
        first = np.concatenate([[0], stops + 1])
        last = np.concatenate([stops, [n]]) - held
        last[-1] = n - 1
        long = last >= first
        if long.any():
            edges = np.zeros(n + 1, dtype=np.int32)
            edges[first[long]] += 1
            edges[last[long] + 1] -= 1
            chosen[np.cumsum(edges[:n]) > 0] = code
    step = HELD[chosen]
    starts, at, steps = [], 0, step.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts, dtype=np.int64)
    codes = chosen[first] if n else chosen
    words = codes.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, dtype=np.uint64)])
    for code, (bits, held) in enumerate(SELECTORS, 1):
        which = np.flatnonzero(codes == code)
        if bits and len(which):
            shifts = np.arange(held, dtype=np.uint64) * np.uint64(bits)
            words[which] |= np.bitwise_or.reduce(padded[first[which][:, None] + np.arange(held)] << shifts, axis=1)
    return words, ids[first[codes == 0]] if n else ids


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids of a block, all words of one selector at a time."""
    codes = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(HELD[codes])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    first = ends - HELD[codes]
    out[first[codes == 0]] = escapes
    for code, (bits, held) in enumerate(SELECTORS, 1):
        which = np.flatnonzero(codes == code)
        if bits and len(which):
            shifts = np.arange(held, dtype=np.uint64) * np.uint64(bits)
            values = (words[which][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[first[which][:, None] + np.arange(held)] = values
    return out[:n]


def encode_image(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file image: header, documents (id, whether it has one, length), per-block offsets, words, escapes."""
    blocks = [encode_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    word_ends = np.cumsum([len(w) for w, _ in blocks], dtype="<u8") if blocks else np.zeros(0, "<u8")
    escape_ends = np.cumsum([len(e) for _, e in blocks], dtype="<u8") if blocks else np.zeros(0, "<u8")
    head = struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), int(word_ends[-1]) if blocks else 0, int(escape_ends[-1]) if blocks else 0, len(blocks))
    arrays = [doc_ids.astype("<i8"), known.astype("u1"), lengths.astype("<u8"), word_ends, escape_ends, *[w.astype("<u8") for w, _ in blocks], *[e.astype("<u8") for _, e in blocks]]
    return head + b"".join(a.tobytes() for a in arrays)


class Image:
    """A file image opened for reading; blocks are decoded one at a time, any of them by its offset."""

    def __init__(self, raw: bytes) -> None:
        magic, docs, self.n, words, escapes, self.blocks = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not a Simple-8b image")
        at = struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.word_ends, self.escape_ends = take("<u8", self.blocks), take("<u8", self.blocks)
        self.words, self.escapes = take("<u8", words), take("<u8", escapes)

    def block(self, k: int) -> np.ndarray:
        a, b = (int(self.word_ends[k - 1]) if k else 0), int(self.word_ends[k])
        c, d = (int(self.escape_ends[k - 1]) if k else 0), int(self.escape_ends[k])
        return decode_block(self.words[a:b], self.escapes[c:d], min(BLOCK, self.n - k * BLOCK))

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint64)


def write_token_files(df: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", image_ids: int = 1 << 18) -> DataFrame:
    """Write all documents' ids, in ascending doc_id order, and return the table of file images in the shared folder.

    Rows: part and seq (their order is the order of the ids), before (ids of earlier images of the part), n_ids, image.
    Each image is a whole file of the format; they lie in Parquet rows, so that Spark's readers and writers reach any
    store (`export_token_files` gives plain files). The texts are dealt by ranges of doc_id, rows of one id by their
    texts and places, so no id fills a task; then sorted and encoded where they lie. A worker holds one image's ids
    (about `image_ids`, more only for a longer document). A null or empty text is the end id alone; null doc_ids come
    first; repeated rows are documents of their own; an empty table gives no images; other columns are not read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(tokenizer_path), np.array([end_id], dtype=np.uint32)
        part, seq, before = None, 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        size = 0

        def image() -> pa.RecordBatch:
            known = np.array([d is not None for d in docs], dtype=bool)
            raw = encode_image(np.array([d or 0 for d in docs], dtype=np.int64), known, np.array(lengths), np.concatenate(ids))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "before", "n_ids", "image"])

        for batch in batches:
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if docs and (size >= image_ids or at != part):
                    yield image()
                    seq, before, size = seq + 1, before + size, 0
                    docs, lengths, ids = [], [], []
                if at != part:
                    part, seq, before = at, 0, 0
                found = bpe.ids(text.as_py() or "")
                docs.append(doc)
                lengths.append(len(found) + 1)
                ids += [found, end]
                size += len(found) + 1
        if docs:
            yield image()

    order = ["doc_id", "_tie", "_row"]
    keyed = key_and_text(df, id_col, text_col).withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return staged(ordered.mapInArrow(encoded, "part int, seq long, before long, n_ids long, image binary"), "token-files", IMAGES_A_FILE)


def read_token_files(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the images."""
    first, n = [], 0
    for part, ids in sorted((r[0], r[1]) for r in images.groupBy("part").sum("n_ids").collect()):  # a number for each part
        first.append((part, n))
        n += ids
    offsets = images.sparkSession.createDataFrame(first, "part int, first long")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                image = Image(raw.as_py())
                ends = np.cumsum(image.lengths.astype(np.int64))
                data = memoryview(image.ids().astype("<u4").tobytes())
                starts = ends - image.lengths.astype(np.int64)
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                docs = pa.array(image.doc_ids.astype(np.int64), mask=image.known == 0)
                yield pa.record_batch([docs, pa.array(starts + base), pa.array(image.lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = images.join(F.broadcast(offsets), "part").selectExpr("first + before AS base", "image")
    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_token_files(images: DataFrame, path: str) -> None:
    """Each image as a file of its own under `path`, named by part and seq, for readers without Spark. A narrow map: every
    task writes its rows' files through the file system of `path` as pyarrow opens it."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for part, seq, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                with store.open_output_stream(f"{root}/{part:06d}-{seq:06d}.ls8b") as out:
                    out.write(raw.as_buffer())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    images.select("part", "seq", "image").mapInArrow(written, "n long").agg(F.sum("n")).collect()
