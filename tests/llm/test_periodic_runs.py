"""Maximal periodic runs against a plain search of every period."""

import random

import numpy as np
import pytest

from lodestone.llm import periodic_runs as pr


def plain_runs(words, least):
    """Every longest stretch of every period, and of equal stretches the one of the smallest period."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(2 * p, least) and i > start:
                best.setdefault((start, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    n, letters = rng.choice([0, 1, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 6])
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        a, p = rng.randrange(n // 2), rng.randrange(1, n // 4)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_random_texts(spark):
    rng = random.Random(12)
    texts = [made(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in pr.periodic_runs(df).collect()}
    for i, words in enumerate(texts):
        want = plain_runs(words, pr.LEAST)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want
        assert got[i].n_words == len(words) and got[i].collapsed == plain_collapsed(words, want)


@pytest.mark.parametrize("least", [2, 4, 12])
def test_texts_beside_each_other(least):
    """Texts that are copies of each other, or go on where another ends, share no run."""
    rng = random.Random(least)
    for _ in range(200):
        texts = [made(rng)[:40] for _ in range(3)]
        texts += [texts[0], texts[0][-5:], []]
        numbers = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], dtype=np.int64)
        sizes = np.array([len(t) for t in texts])
        found, at = pr.find_runs(words, sizes, least).tolist(), 0
        for t in texts:
            mine = [(s - at, e - s, p) for s, e, p in found if at <= s < at + len(t)]
            assert mine == plain_runs(t, least)
            at += len(t)


def test_arrays():
    """Suffixes, common prefixes and range minima against their definitions."""
    rng = np.random.default_rng(3)
    for size, letters in [(1, 1), (60, 1), (90, 2), (300, 3), (200, 150)]:
        s = rng.integers(0, letters, size)
        order, rank = pr.suffix_ranks(s)
        rows = s.tolist()
        assert order.tolist() == sorted(range(size), key=lambda i: rows[i:]) and (rank[order] == np.arange(size)).all()
        common = lambda a, b: next((k for k in range(size) if a + k >= size or b + k >= size or rows[a + k] != rows[b + k]), size)
        lcp = pr.common_prefixes(s, order)
        assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]
        low = rng.integers(0, size, 200)
        high = np.minimum(low + rng.integers(0, size, 200), size - 1)
        assert pr.Minima(lcp)(low, high).tolist() == [int(lcp[a : b + 1].min()) for a, b in zip(low, high)]


def test_very_long_texts(spark):
    n = 400_000
    words = {1: ["a"] * n, 2: [str(i % 50_000) for i in range(n)], 3: [str(i) for i in range(n)]}
    got = {r.doc_id: r for r in pr.periodic_runs(spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()], "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, n, 1)] and got[1].collapsed == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, n, 50_000)] and got[2].collapsed == " ".join(words[2][:50_000])
    assert got[3].runs == [] and got[3].collapsed == " ".join(words[3])


def test_white_space_and_ties(spark):
    """Other white space is part of a word; equal rows are answered each."""
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (None, "x " * 12), (4, "x x " * 12), (5, "x " * 11), (4, "x x " * 12)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, len(r.runs), r.collapsed) for r in pr.periodic_runs(df).collect())
    assert got == [("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 0, 0, ""), ("4", 12, 1, "x x"), ("4", 12, 1, "x x"), ("5", 11, 0, " ".join(["x"] * 11)), ("None", 12, 1, "x")]
