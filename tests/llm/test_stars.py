"""A star with very many spokes: every task that compares sets gets a bounded share of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _common, near_dedup

from .test_brute_force import brute_components


def test_overlaps_of_one_star(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPOKES", 64)
    rng, n = np.random.default_rng(5), 3000
    star = np.unique(rng.integers(0, 1 << 40, 50))
    sets = {0: star} | {i: np.unique(np.concatenate([rng.choice(star, int(rng.integers(0, 50)), replace=False), rng.integers(0, 1 << 40, 20)])) for i in range(1, n)}
    table = spark.createDataFrame([(i, len(s), [int(x) for x in s]) for i, s in sets.items()], "node long, n long, set array<long>")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, n)] + [(1, 2), (3, 2)], "a long, b long")
    got = near_dedup._overlaps(pairs, table)
    want = {(a, b): (len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))) for a, b in [*((i, 0) for i in range(1, n)), (1, 2), (3, 2)]}
    assert {(r.a, r.b): (r.n1, r.n2, r.inside) for r in got.collect()} == want


def test_crowded_buckets(spark, monkeypatch):
    """One bucket with more members than SPOKES gives the same components."""
    monkeypatch.setattr(near_dedup, "SPOKES", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[k] = f"n{rng.integers(10**6)}"
        texts[i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    spec = near_dedup.Spec(3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, spec).collect()}
    assert got == brute_components(texts, 3, 85)


@pytest.fixture()
def plain_joins(spark):
    """No broadcast joins and no adaptive splits: what a task gets is what the operator deals to it."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_hot_keys_are_dealt(spark, plain_joins):
    """100,000 rows of one key: no partition of the join holds more than a few shares of SPOKES rows."""
    rows = spark.range(100_000).select(F.col("id").alias("a"), F.when(F.col("id") < 99_000, 0).otherwise(F.col("id")).alias("b"))
    table = rows.select("b", (F.col("b") * 2).alias("twice")).distinct()
    often = near_dedup._often(rows, "b")
    assert [r.copies for r in often.collect()] == [-(-99_000 // near_dedup.SPOKES)]
    joined = near_dedup._dealt(rows, table, often, "a", "b")
    assert joined.where("twice = 2 * b").count() == 100_000
    assert joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 8 * near_dedup.SPOKES


def test_components_of_a_star(spark):
    """100,000 spokes of one node, and a chain."""
    star = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(200_000, 200_020).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = near_dedup.components(star.union(chain))
    assert {(r.label, r["count"]) for r in labels.groupBy("label").count().collect()} == {(0, 100_001), (200_000, 21)}


def test_copies_and_empty_texts(spark, monkeypatch, plain_joins):
    """Very many copies of one text, rows without words, and near copies of a second text that fill the first buckets."""
    monkeypatch.setattr(near_dedup, "SPOKES", 64)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], "x", *base[k:]]) for k in rng.integers(0, 60, 40)]
    texts = ["one two three four"] * 3000 + [""] * 2000 + [None] * 1000 + near + [" ".join(f"own{i} {j}" for j in range(9)) for i in range(50)]
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, near_dedup.Spec(3, 85)).collect()}
    assert len(got) == len(texts)
    assert {got[i].component_id for i in range(1, 3001)} == {1} and sum(got[i].kept for i in range(1, 3001)) == 1
    assert all(got[i].component_id == i and got[i].kept and got[i].n_shingles == 0 for i in range(3001, 6001))
    want = brute_components({i + 1: t for i, t in enumerate(texts) if i >= 6000}, 3, 85)
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in want} == want


def test_intermediate_tables_go(spark):
    before = set(_common._staged)
    texts = [(i, " ".join(f"w{(i // 3 * 7 + j) % 50}" for j in range(40))) for i in range(60)]
    near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(set(_common._staged) - before) == 1  # the result alone


def test_nothing_frequent_makes_plain_joins(spark):
    """Without frequent keys there is no table of them and no copy in the plan, and tables are counted as they are written."""
    rows = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 10).alias("b"))
    assert near_dedup._often(rows, "b") is None
    table = rows.select("b", (F.col("b") * 2).alias("twice")).distinct()
    joined = near_dedup._dealt(rows, table, None, "a", "b")
    assert joined.count() == 100 and "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    few = _common.staged(rows, "test", counting=F.expr("b > 6"))
    assert _common.n_rows(few) == 30 and few.count() == 100 and _common.n_rows(rows) == 100
    none = _common.staged(rows.where("a < 0"), "test", counting=F.lit(True))
    assert _common.n_rows(none) == 0
    _common.dropped(few, none, None)
