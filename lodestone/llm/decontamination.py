"""Benchmark decontamination by pigeonhole edit matching: exact piece hits, verified with Myers' bit-parallel distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_and_text

MATCHES = "doc_id long, item_id long, distance int, error_budget int, first_word long, last_word long"
#: Characters of items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 1 << 20


def normal(text: str) -> str:
    """Lower case, words parted by single spaces."""
    return " ".join(text.lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item of that many characters; one rate for all lengths."""
    return int(rate * length)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces: whatever `edits` errors hit, one piece stays whole."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item's bit masks for Myers' search; Python's integers hold any number of bits."""

    def __init__(self, item: str) -> None:
        self.item, self.n, self.masks = item, len(item), defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the substring of `text` nearest to the item; the first of equal ones."""
        if (at := text.find(self.item)) >= 0:
            return 0, at + self.n
        masks, full, high = self.masks, (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        least, end = score, 0
        for j, c in enumerate(text):
            equal = masks.get(c, 0)
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            more = down | (full & ~(horizontal | up))
            less = up & horizontal
            if more & high:
                score += 1
            elif less & high:
                score -= 1
            more, less = (more << 1) & full, (less << 1) & full
            up = less | (full & ~(vertical | more))
            down = more & vertical
            if score < least:
                least, end = score, j + 1
        return least, end


    def shortest(self, text: str, distance: int) -> int:
        """The length of the shortest beginning of `text` that is `distance` edits from the item (there must be one)."""
        masks, full, high = self.masks, (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        if score == distance:
            return 0
        for j, c in enumerate(text):
            equal = masks.get(c, 0)
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            more = down | (full & ~(horizontal | up))
            less = up & horizontal
            score += 1 if more & high else -1 if less & high else 0
            if score == distance:
                return j + 1
            # The one carried in: nothing before the text's beginning is free.
            more, less = (more << 1 | 1) & full, (less << 1) & full
            up = less | (full & ~(vertical | more))
            down = more & vertical
        raise ValueError("no beginning of the text is that near")


class Finder:
    """All items of a block: an automaton of their pieces and the patterns to verify with."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float) -> None:
        import ahocorasick

        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and below 1")
        self.patterns, self.backwards, self.edits = [], {}, []
        where: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
        for k, (_, item) in enumerate(items):
            edits = budget(len(item), rate)
            self.patterns.append(Pattern(item))
            self.edits.append(edits)
            for offset, piece in pieces(item, edits):
                # Of equal pieces of one item the first and the last offset tell where a match may lie.
                where[piece][k] = (where[piece].get(k, (offset,))[0], offset)
        self.ids = [i for i, _ in items]
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), [(k, a, b) for k, (a, b) in places.items()]))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, distance, error budget, first word, last word) of the best match of each item within its budget."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, first_offset, last_offset in places:
                at, slack = end - length + 1, self.edits[k]
                lo, hi = max(0, at - last_offset - slack), at - first_offset + self.patterns[k].n + slack
                spans = windows.setdefault(k, [])
                # Hits come by their ends, so a window can reach back only as far as the item is long.
                while spans and lo <= spans[-1][1] and hi >= spans[-1][0]:
                    last = spans.pop()
                    lo, hi = min(lo, last[0]), max(hi, last[1])
                spans.append([lo, hi])
        for k, spans in windows.items():
            distance, end = min((d, a + e) for a, b in spans for d, e in (self.patterns[k].best(text[a:b]),))
            if distance <= self.edits[k]:
                # The match's beginning: the item read backwards along the text before the match's end.
                item = self.patterns[k].item
                if k not in self.backwards:
                    self.backwards[k] = Pattern(item[::-1])
                start = end - self.backwards[k].shortest(text[max(0, end - len(item) - distance) : end][::-1], distance)
                yield self.ids[k], distance, self.edits[k], text.count(" ", 0, start), text.count(" ", 0, end)


@lru_cache(maxsize=4)
def finder(items: tuple[tuple[int, str], ...], rate: float) -> Finder:
    """Built once for each block in a Python worker."""
    return Finder(items, rate)


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items, normalised, in blocks of about BLOCK_CHARS; the driver fetches one partition of them at a time."""
    block, size = [], 0
    for i, text in key_and_text(items, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        if item := normal(text):
            block.append((i, item))
            size += len(item)
        if size >= BLOCK_CHARS:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row and benchmark item that it holds with at most `rate` edits a character.

    Texts are compared lower-cased and with single spaces. An item is cut into its error budget plus one pieces; the
    documents stream past an automaton of all pieces, and only round a piece that is hit word for word is Myers'
    distance taken, so every passage within the budget is found. Of an item's matches in a row the nearest counts, of
    equally near ones the first to end; first_word and last_word are the places among the document's words where it
    begins and ends. Items of equal texts and equal pieces are found each. A narrow map over the documents, one pass for each block of items (a fixed
    number of characters, so what tasks receive doesn't grow with the benchmark). Null or empty texts and items hold
    nothing and match nothing, items without an id are left out; a null doc_id stays null; repeated document rows are
    matched each; empty tables give no rows; other columns are not read.
    """
    texts = key_and_text(docs, id_col, text_col)

    def matched(items: tuple[tuple[int, str], ...]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = finder(items, rate)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            for batch in batches:
                rows = [(doc, *match) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for match in found.find(normal(text.as_py() or ""))]
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "distance", "error_budget", "first_word", "last_word"])

        return texts.mapInArrow(search, MATCHES)

    found = [matched(block) for block in blocks(items, item_id_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], MATCHES)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The document rows that hold no item, with all their columns: a test on each row, without joins.

    Nulls, repeated rows and empty tables as in `contaminated`; a row with a null text stays.
    """
    out = docs
    for block in blocks(items, item_id_col, item_text_col):
        out = out.where(~_holds(block, rate)(F.col(text_col).cast("string")))
    return out


def _holds(items: tuple[tuple[int, str], ...], rate: float):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        found = finder(items, rate)
        return pa.array([next(found.find(normal(t.as_py() or "")), None) is not None for t in texts], pa.bool_())

    return holds
