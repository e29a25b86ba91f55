"""Maximal runs of words that repeat with a period, by a harmonic grid of longest common extensions.

For each period p the grid's places are 0, p, 2p, ... A run of period p and at least 2p words holds two neighbours of
them, so it is seen by extending both, forward and backward, as far as they agree. The extensions are range minima over
the array of longest common prefixes beside a suffix array, of the words and of the reversed words. A text of n words has
about n ln n pairs of places, and each is looked at in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import key_and_text

#: Runs are at least so many words long (and two periods).
LEAST = 12
#: Texts are joined up to so many words, so that short ones share the cost of an array operation; longer ones stand alone.
JOINED = 1 << 17
#: Pairs of places that are extended at once.
PAIRS = 1 << 20
#: Words a block of the range minima.
BLOCK = 16
#: Agreeing words that are compared step by step before long stretches are compared at once.
STEPS = 32

RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_ranks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the symbols and each suffix's rank, by prefix doubling of the groups that are still equal."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1
    open_ = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    step = 1
    while len(open_):
        suffixes = order[open_]
        keys = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n)] + 1
        by = np.argsort(keys, kind="stable")
        keys, suffixes = keys[by], suffixes[by]
        order[open_] = suffixes
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[suffixes] = np.maximum.accumulate(np.where(first, open_, 0))
        open_ = open_[~(first & np.concatenate([first[1:], [True]]))]
        step *= 2
    return order, rank[:n]


def _agreement(s: np.ndarray, a: int, b: int) -> int:
    """How many symbols from a on equal those from b on; s ends with a symbol of its own."""
    at, size = 0, 4 * STEPS
    while True:
        x, y = s[a + at : a + at + size], s[b + at : b + at + size]
        m = min(len(x), len(y))
        apart = np.flatnonzero(x[:m] != y[:m])
        if len(apart):
            return at + int(apart[0])
        at, size = at + m, 2 * size


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By rank, the length of the longest prefix common with the suffix one rank before.

    Only values that don't follow from the place before (whose symbols before both suffixes differ) are compared; their
    sum is at most 2 n log n. All others are their left neighbour's less one.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    ended = np.concatenate([s, [-1]])
    own = np.arange(n)
    fresh = (own == 0) | (before <= 0) | (s[own - 1] != s[np.maximum(before, 1) - 1])
    places = np.flatnonzero(fresh & (before >= 0))
    length = np.zeros(n, dtype=np.int64)
    going = places
    for at in range(STEPS):
        if not len(going):
            break
        going = going[ended[going + at] == ended[before[going] + at]]
        length[going] += 1
    for i in going.tolist():
        length[i] = STEPS + _agreement(ended, i + STEPS, int(before[i]) + STEPS)
    known = np.maximum.accumulate(np.where(fresh, own, 0))
    by_place = np.maximum(length[known] - (own - known), 0)
    by_place[before < 0] = 0
    return by_place[order]


class Minima:
    """Least values over ranges of an array: minima of blocks in a table of doubling widths, and running ones in a block."""

    def __init__(self, values: np.ndarray) -> None:
        n = -(-max(len(values), 1) // BLOCK) * BLOCK
        self.values = np.full(n, np.iinfo(np.int32).max, dtype=np.int32)
        self.values[: len(values)] = values
        rows = self.values.reshape(-1, BLOCK)
        self.up_to = np.minimum.accumulate(rows, axis=1).ravel()
        self.from_ = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from low to high, both included."""
        left, right = low // BLOCK, high // BLOCK
        out = np.minimum(self.from_[low], self.up_to[high])
        same = np.flatnonzero(left == right)
        if len(same):
            least, end = self.values[low[same]], high[same]
            for i in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(low[same] + i, end)])
            out[same] = least
        far = np.flatnonzero(right - left > 1)
        if len(far):
            a, width = left[far] + 1, right[far] - left[far] - 1
            level = np.frexp(width.astype(float))[1] - 1
            for k in np.unique(level).tolist():
                of = level == k
                at = far[of]
                row = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[a[of]], row[a[of] + width[of] - (1 << k)]))
        return out


class Extensions:
    """How far two different places agree to the right: the least common prefix between their ranks."""

    def __init__(self, s: np.ndarray) -> None:
        order, self.rank = suffix_ranks(s)
        self.minima = Minima(common_prefixes(s, order))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.minima(np.minimum(x, y) + 1, np.maximum(x, y))


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of neighbouring places (left place, period) of all periods of all texts, some PAIRS at a time."""
    halves = sizes // 2
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (sizes[text] - 1) // period
    ends = np.cumsum(counts)
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, done + PAIRS, side="right")), at + 1)
        n = counts[at:stop]
        p = np.repeat(period[at:stop], n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[text[at:stop]], n) + j * p, p
        at = stop


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs as rows (start, end, period), by start and period, of texts one after the other: each word's number, each
    text's number of words. A run lies in one text, is as long as it can be, and its period is its smallest."""
    n = len(words)
    ends = np.cumsum(sizes)
    # A word is another symbol in each text: no extension leaves its text, and texts are sorted apart.
    symbols = words + np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1)
    right = left = None
    found = [np.zeros((0, 3), dtype=np.int64)]
    for a, p in _grid(ends - sizes, sizes):
        equal = symbols[a] == symbols[a + p]  # places that differ at once extend by nothing
        a, p = a[equal], p[equal]
        if not len(a):
            continue
        if right is None:
            right, left = Extensions(symbols), Extensions(symbols[::-1].copy())
        forward, back = right(a, a + p).astype(np.int64), np.zeros(len(a), dtype=np.int64)
        inner = np.flatnonzero(a > 0)
        back[inner] = left(n - a[inner], n - a[inner] - p[inner])
        # A run is taken at the first of its places alone; one of too few words isn't a run.
        run = (back < p) & (back + forward >= p) & (back + forward + p >= least)
        found.append(np.stack([(a - back)[run], (a + p + forward)[run], p[run]], axis=1))
    runs = np.concatenate(found)
    # The same stretch is found for multiples of its period too: the smallest is its own.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _of_texts(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs (start, length, period) and the collapsed text of each list of words."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    runs = find_runs(words, sizes, least)
    ends = np.cumsum(sizes)
    bounds = np.searchsorted(runs[:, 0], np.concatenate([[0], ends])).tolist()
    for i, text in enumerate(texts):
        mine = runs[bounds[i] : bounds[i + 1]] - np.array([ends[i] - sizes[i], ends[i] - sizes[i], 0])
        if not len(mine):
            yield [], b" ".join(text)
            continue
        edges = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(edges, mine[:, 0] + mine[:, 2], 1)
        np.add.at(edges, mine[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        yield list(zip(mine[:, 0].tolist(), (mine[:, 1] - mine[:, 0]).tolist(), mine[:, 2].tolist())), b" ".join([text[k] for k in kept.tolist()])


def periodic_runs(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    Words are parted by ASCII white space and numbered from 0. A run is a longest stretch of at least `least` words and
    two of its smallest period's, whose words a period apart are equal. Collapsed, a text keeps the words that no run
    holds after its own first period, joined by single spaces. One pass without a shuffle; memory goes with a batch's
    texts and some 200 bytes a word of one text, however long.
    A null or empty text, or one of white space alone, has no words, no runs and an empty collapsed text; a null doc_id
    stays null; repeated rows are treated each; an empty table gives no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            at = 0
            while at < len(ids):
                some: list[list[bytes]] = []
                held = 0
                while at + len(some) < len(ids) and held < JOINED:
                    some.append((texts[at + len(some)].as_py() or b"").split())
                    held += len(some[-1])
                runs, collapsed = zip(*_of_texts(some, least))
                yield pa.record_batch(
                    [
                        pa.array(ids[at : at + len(some)], pa.int64()),
                        pa.array([len(t) for t in some], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs], pa.list_(_RUN)),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(some)

    return key_and_text(df, id_col, text_col).mapInArrow(scan, RESULT)
