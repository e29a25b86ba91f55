"""Token counts by heap-and-linked-list pair merging over the vocabulary of a sentencepiece BPE model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import key_and_text

COUNTS = "doc_id long, n_bytes long, n_tokens long"
MARK = "▁"
UNIT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
#: Entries that a worker keeps in each of its tables of counted words; a full table starts anew. Counts don't depend on it.
KEPT_WORDS = 400_000


def pair_merge_count(text: str, score: dict[str, float]) -> int:
    """Symbols left after all merges: the initial symbols minus the merges; characters without a piece count as bytes.

    A heap holds the adjacent pairs that are pieces, best score first and leftmost among equals; a linked list holds
    the symbols. Each pop joins a pair that still stands and offers the two pairs next to it. No ids are made.
    """
    symbols: list[str] = list(text)
    n = len(symbols)
    count = sum(1 if c in score else len(c.encode("utf-8")) for c in symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1] if n else []
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (s := score.get(symbols[a] + symbols[b])) is not None:
            heappush(heap, (-s, a, b, len(symbols[a]) + len(symbols[b])))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, size = heappop(heap)
        if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
            continue
        symbols[a] += symbols[b]
        symbols[b] = ""
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        count -= 1
        offer(before[a], a)
        offer(a, after[a])
    return count


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message: (number, integer or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class PieceCounter:
    """Counts of a sentencepiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            spec = next((dict(_fields(v)) for k, v in _fields(f.read()) if k == 3), {})
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # Normalizer: a table of replaced characters (2), a mark before the text (3), removal of extra spaces (4), spaces as marks (5).
        if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1) or not model.is_byte(3):
            raise ValueError(f"{path}: only BPE models with byte fallback, a leading mark and no rewriting are handled")
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError(f"{path}: pieces that cross words are not handled")
        self.newline_alone = not any("\n" in p for p in self.score)
        self.marked, self.bare = _Counts(self.score, MARK), _Counts(self.score, "")

    def count(self, text: str) -> int:
        """Tokens of the text. No piece holds a mark after another character, nor a line end: merges never cross a
        space that follows a word, nor a line end, so words are counted apart and each distinct word only once."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if not self.newline_alone or "  " in text or "\n " in text or text[0] == " ":
            return self._slow(text)
        lines = text.split("\n")
        total, marked, bare = len(lines) - 1, self.marked.__getitem__, self.bare.__getitem__
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i:
                total += bare(words[0]) + sum(map(marked, words[1:]))
            else:
                total += sum(map(marked, words))
        return total

    def _slow(self, text: str) -> int:
        """The same where spaces meet spaces: a unit begins at each mark that follows another character."""
        return sum(pair_merge_count(unit, self.score) for unit in UNIT.split(MARK + text.replace(" ", MARK)))


class _Counts(dict):
    """Counts of words already seen, for words after a mark or without one."""

    def __init__(self, score: dict[str, float], head: str) -> None:
        super().__init__()
        self.score, self.head = score, head

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = pair_merge_count(self.head + word, self.score) if self.head + word else 0
        if len(word) < 64:
            self[word] = n
        return n


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    """Loaded once in each Python worker."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text.

    A narrow map without any shuffle; a worker's memory is a batch of texts plus bounded tables of counted words. A null
    or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted each; an empty table
    gives no rows; other columns are not read. Very long texts without spaces take n log n steps on the heap.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(map(counter.count, texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return key_and_text(df, id_col, text_col).mapInArrow(counted, COUNTS)
