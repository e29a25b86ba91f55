"""What a worker of the language model holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.llm import _common, lm_scoring


def batch(n=1 << 18, v=20_000):
    rng = np.random.default_rng(3)
    words = np.sort(np.append(rng.integers(1, 1 << 63, v, dtype=np.uint64), np.uint64(lm_scoring.START)))
    lengths = np.full(n // 256, 256)
    places = np.flatnonzero(words != np.uint64(lm_scoring.START))
    tokens = places[np.minimum((rng.pareto(0.8, n) * 20).astype(np.int64), v - 1)].astype(np.int32)
    return words, tokens, lengths, np.arange(len(lengths)) % 7 != 2


def test_grams_of_a_batch_take_few_bytes_a_token():
    words, tokens, lengths, train = batch()
    tracemalloc.start()
    grams = lm_scoring._Grams(words, tokens, lengths, train, 3, 8, words[:5])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(tokens)
    assert sum(int(c.sum()) for c in grams.counts[1:]) == int(np.repeat(train, lengths).sum()) * 2 - int(train.sum())


def test_places_are_those_of_numpy():
    rng = np.random.default_rng(1)
    for path, bits in ((rng.integers(0, 50, 1000), 6), (rng.integers(0, 1 << 61, 1000), 61), (np.zeros(1, np.int64), 1), (np.zeros(0, np.int64), 40)):
        found, where = lm_scoring._distinct(path.copy(), bits)
        want = np.unique(path, return_inverse=True)
        assert (found == want[0]).all() and (where == want[1]).all()


def test_large_rows_go_to_python_a_few_at_a_time(spark):
    rows = spark.range(0, 24, 1, 1).selectExpr("id", "CAST(repeat('x', CAST(1048576 + id AS int)) AS binary) AS raw")
    counted = rows.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    with _common.small_batches(spark):
        assert max(r.n for r in counted.collect()) <= 5
