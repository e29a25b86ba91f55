"""Benchmark items of all lengths at one error rate, equal pieces, and where matches begin."""

import random

import pytest

from lodestone.llm import decontamination
from lodestone.llm.decontamination import Finder, budget, normal

from .test_brute_force import nearest


def test_one_rate_for_all_lengths():
    assert [budget(n, 0.08) for n in (1, 12, 13, 19, 25, 29, 38, 39, 100)] == [0, 0, 1, 1, 2, 2, 3, 3, 8]
    rng = random.Random(8)
    for length in range(13, 60):
        item = "".join(rng.choice("abcdefgh ") for _ in range(length - 2))
        item = f"q{item}q".replace("  ", " x")
        chars = list(normal(item))
        for k in rng.sample(range(len(chars)), budget(len(chars), 0.08)):
            chars[k] = "z"
        text = normal("some words before " + "".join(chars) + " and after")
        assert [i for i, *_ in Finder(((7, normal(item)),), 0.08).find(text)] == [7], item


def test_equal_pieces_and_equal_items():
    items = ((1, "abab abab abab abab abab abab"), (2, "abab abab abab abab abab abab"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"))
    rng = random.Random(1)
    finder = Finder(items, 0.1)
    for _ in range(80):
        text = normal("".join(rng.choice(["abab ", "abab ", "aab ", "aaaaaaaa", "b"]) for _ in range(rng.randrange(14))))
        want = {(i, d) for i, x in items if (d := nearest(x, text)) <= budget(len(x), 0.1)}
        assert {(i, d) for i, d, *_ in finder.find(text)} == want


def test_matches_begin_where_they_begin():
    rng = random.Random(3)
    for _ in range(200):
        item = normal(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(4, 12))))
        chars = list(item)
        for k in rng.sample(range(len(chars)), budget(len(chars), 0.1)):
            chars[k] = rng.choice(["", "z", "zz"])
        text = normal("zz yy " * rng.randrange(4) + "".join(chars) + " xx" * rng.randrange(4))
        for _, distance, _, first, last in Finder(((1, item),), 0.1).find(text):
            words = text.split(" ")[first : last + 1]
            assert nearest(item, " ".join(words)) == distance
            assert len(words) <= len(item.split(" ")) + distance + 1


def test_rates():
    with pytest.raises(ValueError):
        Finder(((1, "a"),), 1.0)


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (None, "one two tree four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "two three four five six"), (None, "one"), (6, None), (7, "")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.distance, r.first_word, r.last_word) for r in decontamination.contaminated(docs, items).collect()))
    assert got == [(0, 5, 1, 1, 5), (1, 5, 0, 1, 5), (1, 5, 0, 1, 5)]
