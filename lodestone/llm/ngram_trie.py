"""An n-gram trie in compact levels: Elias-Fano child pointers, quantised smoothed probabilities, successor search."""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Steps of a code in log10; codes run from 0 (that is 1, or any smaller count's logarithm) to 65535.
STEP = 2048
NEVER = 65535
#: Bits of a word's hash that tell the children of one node apart.
CHILD_BITS = 48
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def code(log10: np.ndarray) -> np.ndarray:
    """16-bit codes of logarithms by size alone: -log10 p of a probability p, or log10 n of a number n."""
    return np.minimum(np.rint(np.abs(log10) * STEP), NEVER - 1).astype("<u2")


class EliasFano:
    """A rising sequence of integers: low bits as they are, high bits in unary, with a count of ones for each word."""

    def __init__(self, low: np.ndarray, high: np.ndarray, shift: int) -> None:
        self.low, self.high, self.shift = low, high, np.uint64(shift)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(low bits, words of high bits, number of low bits) of a rising sequence."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        shift = min(32, max(0, (top // max(n, 1)).bit_length() - 1))
        values = values.astype(np.uint64)
        low = (values & np.uint64((1 << shift) - 1)).astype("<u1" if shift <= 8 else "<u2" if shift <= 16 else "<u4")
        bits = np.zeros((((top >> shift) + n) // 64 + 1) * 64, dtype=np.uint8)
        bits[(values >> np.uint64(shift)).astype(np.int64) + np.arange(n)] = 1
        return low, np.packbits(bits, bitorder="little").view("<u8"), shift

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        word = np.searchsorted(self.before, i, side="right") - 1
        left = i - self.before[word]
        bits, at = self.high[word].copy(), np.zeros(len(i), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the place of the left-th one in its word
            inside = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= inside
            left = left - np.where(up, inside, 0)
            at += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return ((word * 64 + at - i) << int(self.shift)) | self.low[i].astype(np.int64)


class Level:
    """Nodes of one length: keys, codes, and where each node's children lie in the next level."""

    def __init__(self, keys: np.ndarray, share: np.ndarray, rest: np.ndarray, pointers: EliasFano | None) -> None:
        self.keys, self.share, self.rest, self.pointers = keys, share, rest, pointers


def _whole(raw: np.ndarray) -> np.ndarray:
    """Keys of six bytes as integers."""
    out = np.zeros((len(raw), 8), dtype="u1")
    out[:, : raw.shape[1]] = raw
    return out.view("<u8").ravel()


class Trie:
    """Levels 1 to the order, read from one buffer without copying.

    Level 1 has the words by their 64-bit hashes, deeper ones each node's children by 48 bits of their last word's hash,
    rising under each parent. `share` codes a node's own part of its smoothed probability: of a word, its count plus one
    (to be divided by the model's total); of a longer n-gram, count / (parent's count + weight). `rest` codes what a
    node leaves to shorter contexts: weight / (count + weight).
    """

    def __init__(self, raw: bytes | mmap.mmap) -> None:
        (n,) = struct.unpack_from("<I", raw)
        head = struct.unpack_from(f"<{6 * n}Q", raw, 4)
        at, self.levels = 4 + 48 * n, []
        for k in range(n):
            size, width, low, low_size, high, shift = head[6 * k : 6 * k + 6]
            take = lambda kind, count: np.frombuffer(raw, kind, count, at)
            keys = take("<u8", size) if width == 8 else take("u1", size * width).reshape(size, width)
            at += size * width
            share = take("<u2", size)
            at += 2 * size
            rest = take("<u2", size)
            at += 2 * size
            pointers = None
            if high:
                lows = take(f"<u{low_size}", low)
                at += low * low_size
                pointers = EliasFano(lows, take("<u8", high), shift)
                at += 8 * high
            self.levels.append(Level(keys, share, rest, pointers))

    @staticmethod
    def packed(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]) -> bytes:
        """A buffer of (keys, share codes, rest codes, first child of each node and the end) for each level."""
        head, body = [], []
        for k, (keys, share, rest, first) in enumerate(levels):
            low, high, shift = EliasFano.parts(first) if first is not None else (np.zeros(0, "<u1"), np.zeros(0, "<u8"), 0)
            width = 8 if k == 0 else CHILD_BITS // 8
            raw = keys.astype("<u8").tobytes() if k == 0 else np.ascontiguousarray(keys.astype("<u8").view("u1").reshape(-1, 8)[:, :width]).tobytes()
            head += [len(keys), width, len(low), low.itemsize, len(high), shift]
            body += [raw, share.tobytes(), rest.tobytes(), low.tobytes(), high.tobytes()]
        return struct.pack("<I", len(levels)) + struct.pack(f"<{len(head)}Q", *head) + b"".join(body)

    def roots(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of level 1 by hash; -1 where there is none."""
        have = self.levels[0].keys
        at = np.searchsorted(have, keys)
        found = at < len(have)
        found[found] = have[at[found]] == keys[found]
        return np.where(found, at, -1)

    def children(self, depth: int, parents: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Nodes of level depth + 1 by parent (in level `depth`, -1: none) and key; -1 where there is none.

        The parent's pointers give the range of its children; the key is searched there alone, by halving.
        """
        out = np.full(len(parents), -1, dtype=np.int64)
        some = np.flatnonzero(parents >= 0)
        level, pointers = self.levels[depth], self.levels[depth - 1].pointers
        if not len(some) or not len(level.keys):
            return out
        lo, hi = pointers.get(parents[some]), pointers.get(parents[some] + 1)
        end, want, have = hi.copy(), keys[some], _whole(level.keys)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # only ranges that are still open are looked at
            middle = (lo[open_] + hi[open_]) >> 1
            less = have[middle] < want[open_]
            lo[open_[less]], hi[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        found[found] = have[lo[found]] == want[found]
        out[some[found]] = lo[found]
        return out


def mapped(raw: bytes) -> Trie:
    """The trie in memory mapped apart from Python's heap, given back as a whole when the trie goes."""
    area = mmap.mmap(-1, max(len(raw), 1))
    area.write(raw)
    return Trie(area)
