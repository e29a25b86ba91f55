"""Main text of web pages by a recurrent labeller: a bidirectional LSTM reads a page's leaf blocks and judges each.

A block is read as its tag path, its hashed words and a few measures. Two memories, one from the page's start and one
from its end, carry what the rest of the page says to every block. The model is small, trained here on made pages
(`page_layouts`) in some seconds, from a fixed seed, and sent to the tasks as it is.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import PATHS, Block, hashed, leaf_blocks
from .page_layouts import labelled_pages

WORDS, OWN, HIDDEN = 2048, 64, 24
WORD_DIM, PATH_DIM, OWN_DIM, MEASURES = 12, 16, 8, 10
#: The bounded sample of labelled pages that the model is fitted to, and how.
TRAINING_PAGES, EPOCHS, PAGES_A_STEP, RATE, SEED = 3500, 6, 24, 0.006, 11
#: Blocks and words that a task reads at once, beyond the page that fills them.
BLOCKS_AT_ONCE, WORDS_AT_ONCE = 20_000, 1_000_000
KEPT_WORDS = 1 << 17

RESULT = "page_id long, url string, text string"


class _Words(dict):
    """Hashed words; a full table starts anew."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = hashed(word, WORDS)
        return found


_words = _Words()
Model = dict[str, np.ndarray]


class Features:
    """The blocks of pages, one after the other, as arrays: word and path numbers with their bounds, elements, measures."""

    def __init__(self, pages: list[list[Block]]) -> None:
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        blocks = [b for p in pages for b in p]
        # A block's distinct words: one that is repeated a hundred times says no more.
        split = [dict.fromkeys(b.text.lower().split(" ")) for b in blocks]
        self.words = np.fromiter((_words[w] for s in split for w in s), np.int32)
        self.n_words = np.array([len(s) for s in split], dtype=np.int64)
        paths: dict[frozenset[int], int] = {}
        self.path = np.array([paths.setdefault(b.path, len(paths)) for b in blocks], dtype=np.int64)
        self.paths = [sorted(p) for p in paths]
        self.own = np.array([hashed(b.own, OWN) for b in blocks], dtype=np.int64)
        self.measures = self._measured(blocks)

    def _measured(self, blocks: list[Block]) -> np.ndarray:
        chars = np.array([len(b.text) for b in blocks], dtype=np.float32)
        counts = np.array([[sum(map(b.text.count, ".,;:!?")), sum(map(b.text.count, "0123456789")) if len(b.text) < 400 else 0, b.text[0].isupper(), b.text[-1] in ".!?", "©" in b.text, min(b.linked, len(b.text))] for b in blocks], dtype=np.float32).reshape(-1, 6)
        place = (np.arange(len(blocks)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)) / np.maximum(np.repeat(self.sizes, self.sizes), 1)
        return np.stack(
            [np.log1p(self.n_words) / 5, np.log1p(chars) / 7, counts[:, 0] / np.maximum(self.n_words, 1), counts[:, 1] / np.maximum(chars, 1), counts[:, 2], counts[:, 3], counts[:, 4], counts[:, 5] / np.maximum(chars, 1), place, np.ones(len(blocks))], axis=1
        ).astype(np.float32)


def _inputs(model: Model, f: Features) -> np.ndarray:
    """One row of inputs for each block."""
    at = np.cumsum(f.n_words) - f.n_words
    words = np.add.reduceat(model["words"][f.words], at, axis=0) / np.sqrt(f.n_words)[:, None] if len(at) else np.zeros((0, WORD_DIM), np.float32)
    paths = np.stack([model["paths"][p].sum(axis=0) for p in f.paths]) if f.paths else np.zeros((0, PATH_DIM), np.float32)
    return np.concatenate([words, paths[f.path], model["own"][f.own], f.measures], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _judged_from(model: Model, side: str, x: np.ndarray, sizes: np.ndarray, starts: np.ndarray, backward: bool) -> np.ndarray:
    """One direction's share of each block's score. Pages step together, the longest first, so that those still open are a
    prefix; of the steps before only the memories are kept."""
    u, out = model[f"u{side}"], model[f"o{side}"]
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    still = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    h, c = np.zeros((len(sizes), HIDDEN), np.float32), np.zeros((len(sizes), HIDDEN), np.float32)
    score = np.zeros(len(x), dtype=np.float32)
    fed = x @ model[f"w{side}"] + model[f"b{side}"]
    for t in range(longest):
        n = int(still[t])
        rows = starts[:n] + (sizes[:n] - 1 - t if backward else t)
        z = fed[rows] + h[:n] @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        c[:n] = gates[:, HIDDEN : 2 * HIDDEN] * c[:n] + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
        h[:n] = gates[:, 2 * HIDDEN :] * np.tanh(c[:n])
        score[rows] = h[:n] @ out
    return score


def judged(model: Model, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, the chance of each of its blocks to be main text."""
    f = Features(pages)
    x, starts = _inputs(model, f), np.cumsum(f.sizes) - f.sizes
    score = x @ model["direct"] + model["bias"]
    score += _judged_from(model, "f", x, f.sizes, starts, False) + _judged_from(model, "b", x, f.sizes, starts, True)
    return np.split(_sigmoid(score), np.cumsum(f.sizes)[:-1]) if len(pages) else []


# Training: the same network with its steps kept, and Adam.


def _new_model(rng: np.random.Generator) -> Model:
    size = WORD_DIM + PATH_DIM + OWN_DIM + MEASURES
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = {"words": draw(WORDS, WORD_DIM, scale=0.1), "paths": draw(PATHS, PATH_DIM, scale=0.2), "own": draw(OWN, OWN_DIM, scale=0.2), "direct": draw(size, scale=0.1), "bias": np.zeros(1, np.float32)}
    for side in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        model |= {f"w{side}": draw(size, 4 * HIDDEN, scale=0.2), f"u{side}": draw(HIDDEN, 4 * HIDDEN, scale=0.2), f"b{side}": bias, f"o{side}": draw(HIDDEN, scale=0.2)}
    return model


def _both_ways(model: Model, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (steps, 2, pages, HIDDEN) over padded inputs (steps, 2, pages, size), forward and backward side by
    side, and what the way back needs."""
    w, u, b = (np.stack([model[f"{k}f"], model[f"{k}b"]]) for k in "wub")
    h = c = np.zeros((2, x.shape[2], HIDDEN), np.float32)
    fed, states, kept = x @ w + b[:, None], [], []
    for t in range(len(x)):
        z = fed[t] + h @ u
        gates, fresh = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
        i, forget, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        m = mask[t][:, None]
        next_c = np.where(m, forget * c + i * fresh, c)
        shown = np.tanh(next_c)
        next_h = np.where(m, o * shown, h)
        kept.append((i, forget, o, fresh, c, h, shown, m))
        h, c = next_h, next_c
        states.append(h)
    return np.stack(states), kept


def _way_back(model: Model, x: np.ndarray, kept: list, d_states: np.ndarray, grads: Model) -> np.ndarray:
    """Gradients of both directions; returns those of their inputs."""
    w, u = (np.stack([model[f"{k}f"], model[f"{k}b"]]) for k in "wu")
    w_back, u_back = w.transpose(0, 2, 1), np.ascontiguousarray(u.transpose(0, 2, 1))
    d_h = d_c = np.zeros_like(kept[0][5])
    d_z = np.zeros((len(kept), *d_h.shape[:2], 4 * HIDDEN), x.dtype)
    for t in reversed(range(len(kept))):
        i, forget, o, fresh, c, h, shown, m = kept[t]
        d_h = d_h + d_states[t]
        through_h, through_c = np.where(m, d_h, 0), np.where(m, d_c, 0)
        into_c = through_c + through_h * o * (1 - shown * shown)
        z = d_z[t]
        z[..., :HIDDEN] = into_c * fresh * i * (1 - i)
        z[..., HIDDEN : 2 * HIDDEN] = into_c * c * forget * (1 - forget)
        z[..., 2 * HIDDEN : 3 * HIDDEN] = through_h * shown * o * (1 - o)
        z[..., 3 * HIDDEN :] = into_c * i * (1 - fresh * fresh)
        d_h = np.where(m, 0, d_h) + z @ u_back
        d_c = np.where(m, into_c * forget, d_c)
    # Products of small matrices, step by step: large ones would be dealt to threads that wait busily for the next.
    before = np.stack([k[5] for k in kept])
    of_u, of_w = (np.matmul(y.transpose(0, 1, 3, 2), d_z).sum(axis=0) for y in (before, x))
    for side, name in enumerate("fb"):
        grads[f"u{name}"], grads[f"w{name}"], grads[f"b{name}"] = of_u[side], of_w[side], d_z[:, side].sum(axis=(0, 1))
    return d_z @ w_back


def gradients(model: Model, f: Features, labels: np.ndarray) -> tuple[float, Model]:
    """Mean loss of the pages' blocks, and its gradients."""
    rows, steps, n_pages = _inputs(model, f), int(f.sizes.max()), len(f.sizes)
    page = np.repeat(np.arange(n_pages), f.sizes)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(f.sizes) - f.sizes, f.sizes)
    ends = (f.sizes[page] - 1 - step, page)
    x, mask = np.zeros((steps, 2, n_pages, rows.shape[1]), np.float32), np.zeros((steps, n_pages), bool)
    x[step, 0, page], x[ends[0], 1, page], mask[step, page] = rows, rows, True
    states, kept = _both_ways(model, x, mask)
    forth, back = states[step, 0, page], states[ends[0], 1, page]
    score = rows @ model["direct"] + model["bias"] + forth @ model["of"] + back @ model["ob"]
    y, p = labels.astype(np.float32), _sigmoid(score)
    loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    d = ((p - y) / len(y)).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    grads["of"], grads["ob"], grads["direct"], grads["bias"] = forth.T @ d, back.T @ d, rows.T @ d, d.sum(keepdims=True)
    d_states = np.zeros_like(states)
    d_states[step, 0, page], d_states[ends[0], 1, page] = d[:, None] * model["of"], d[:, None] * model["ob"]
    d_x = _way_back(model, x, kept, d_states, grads)
    d_rows = d[:, None] * model["direct"] + d_x[step, 0, page] + d_x[ends[0], 1, page]
    a, b, c = WORD_DIM, WORD_DIM + PATH_DIM, WORD_DIM + PATH_DIM + OWN_DIM
    np.add.at(grads["words"], f.words, np.repeat(d_rows[:, :a] / np.sqrt(f.n_words)[:, None], f.n_words, axis=0))
    by_path = np.zeros((len(f.paths), PATH_DIM), np.float32)
    np.add.at(by_path, f.path, d_rows[:, a:b])
    for numbers, g in zip(f.paths, by_path):
        grads["paths"][numbers] += g
    np.add.at(grads["own"], f.own, d_rows[:, b:c])
    return loss, grads


def labelled_blocks(count: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks of made pages, each with whether it begins in main text; pages without blocks are left out."""
    pages, labels = [], []
    for page, spans in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        if blocks:
            pages.append(blocks)
            labels.append(np.array([any(a <= b.start < z for a, z in spans) for b in blocks]))
    return pages, labels


@lru_cache(maxsize=4)
def trained(count: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The model, fitted to `count` made pages; the same for the same arguments."""
    pages, labels = labelled_blocks(count, seed)
    model, rng = _new_model(np.random.default_rng(seed)), random.Random(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    # Pages of about one length step together, in another order each time.
    order = list(range(len(pages)))
    pools = [sorted(order[at : at + 16 * PAGES_A_STEP], key=lambda i: len(pages[i])) for at in range(0, len(order), 16 * PAGES_A_STEP)]
    together = [pool[at : at + PAGES_A_STEP] for pool in pools for at in range(0, len(pool), PAGES_A_STEP)]
    steps = [(Features([pages[i] for i in some]), np.concatenate([labels[i] for i in some])) for some in together]
    done = 0
    for _ in range(epochs):
        rng.shuffle(steps)
        for features, truth in steps:
            _, grads = gradients(model, features, truth)
            done += 1
            rate = RATE * (1 - done / (epochs * len(steps) + 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items()}


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url and text of every page: its blocks that are main text, in page order, joined by one space.

    References are decoded, white space within a block (no-break spaces too) is one space. The whole page is read, however
    long. Pages are read in groups of some 20,000 blocks or a million words, without a shuffle; the model (half a
    megabyte, whatever the input) goes to the tasks with their code.
    A null, empty or wordless page has an empty text; null ids and addresses stay null; repeated rows are treated each;
    an empty table gives no rows; other columns are not read.
    """
    model = model or trained()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                pages: list[list[Block]] = []
                n_blocks = n_words = 0
                while at + len(pages) < batch.num_rows and n_blocks < BLOCKS_AT_ONCE and n_words < WORDS_AT_ONCE:
                    page = leaf_blocks(batch.column(2)[at + len(pages)].as_py() or "")
                    pages.append(page)
                    n_blocks += len(page)
                    n_words += sum(b.text.count(" ") + 1 for b in page)
                texts = [" ".join(b.text for b, c in zip(page, chances) if c > 0.5) for page, chances in zip(pages, judged(model, pages))]
                yield pa.record_batch([batch.column(0).slice(at, len(pages)), batch.column(1).slice(at, len(pages)), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
                at += len(pages)

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(extract, RESULT)
