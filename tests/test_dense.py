"""Nearest neighbours in blocks against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense


def plain(corpus, queries, k):
    out = {}
    for qid, q in queries.items():
        ranked = sorted((round(float(((np.float64(q) - np.float64(x)) ** 2).sum()), 6), i) for i, x in corpus.items())[:k]
        out |= {(qid, n): (i, d) for n, (d, i) in enumerate(ranked, 1)}
    return out


def found(df, id_col="chunk_id"):
    return {(r.qid, r["rank"]): (r[id_col], r.dist) for r in df.collect()}


def frames(spark, corpus, queries, id_type="long", q_type="long"):
    vectors = lambda rows: [(i, [float(v) for v in x]) for i, x in rows.items()]
    return spark.createDataFrame(vectors(corpus), f"chunk_id {id_type}, dense_vector array<float>").repartition(5), spark.createDataFrame(vectors(queries), f"qid {q_type}, dense array<float>").repartition(3)


@pytest.mark.parametrize(("id_type", "q_type"), [("long", "int"), ("string", "string"), ("int", "long"), ("string", "smallint")])
def test_ids_of_any_type(spark, monkeypatch, id_type, q_type):
    """With ties: vectors of few whole numbers. Small blocks, so that they are many."""
    monkeypatch.setattr(dense, "BLOCK_VECTORS", 7)
    rng = np.random.default_rng(1)
    name = lambda t, i: f"n{i}" if t == "string" else i
    corpus = {name(id_type, i): rng.integers(0, 2, 4).astype(np.float32) for i in range(150)}
    queries = {name(q_type, i): rng.integers(0, 2, 4).astype(np.float32) for i in range(40)}
    c, q = frames(spark, corpus, queries, id_type, q_type)
    for k in (1, 10, 200):
        got = dense.search_dense(c, q, k)
        assert dict(got.dtypes)["qid"] == dict(q.dtypes)["qid"] and found(got) == plain(corpus, queries, k)


def test_vectors_of_large_norm(spark):
    """Far from the origin the expansion of the distance loses digits; the distances don't."""
    rng = np.random.default_rng(2)
    corpus = {i: (rng.standard_normal(16) + 1e5).astype(np.float32) for i in range(300)}
    queries = {i: (rng.standard_normal(16) + 1e5).astype(np.float32) for i in range(20)}
    assert found(dense.search_dense(*frames(spark, corpus, queries), 5)) == plain(corpus, queries, 5)


def test_many_queries_one_scan(spark, tmp_path):
    """Ten thousand queries: no job while the plan is made, one scan of the corpus, no query on the driver."""
    rng = np.random.default_rng(3)
    corpus = {i: rng.standard_normal(8).astype(np.float32) for i in range(500)}
    queries = {i: rng.standard_normal(8).astype(np.float32) for i in range(10_000)}
    c, q = frames(spark, corpus, queries)
    c.write.parquet(str(tmp_path / "corpus"))
    q.write.parquet(str(tmp_path / "queries"))
    c, q = spark.read.parquet(str(tmp_path / "corpus")), spark.read.parquet(str(tmp_path / "queries"))
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        df = dense.search_dense(c, q, 3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark._jsc.clearJobGroup()
    assert plan.count("FileScan parquet [chunk_id") == 1
    got = found(df)
    some = {i: queries[i] for i in range(0, 10_000, 500)}
    assert len(got) == 30_000 and {k: v for k, v in got.items() if k[0] in some} == plain(corpus, some, 3)


def test_pairs_of_partitions(spark):
    """Queries too large to broadcast: pairs of partitions, the same rows."""
    rng = np.random.default_rng(4)
    corpus = {i: rng.standard_normal(8).astype(np.float32) for i in range(200)}
    queries = {i: rng.standard_normal(8).astype(np.float32) for i in range(300)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = dense.search_dense(*frames(spark, corpus, queries), 4)
        assert "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString()
        assert found(df) == plain(corpus, queries, 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_odd_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "a"), (None, [0.0, 0.0], "a"), (3, [0.0, 2.0], "b"), (1, [1.0, 0.0], "a")], "chunk_id long, dense_vector array<double>, kind string")
    queries = spark.createDataFrame([(7, [0.0, 0.0]), (8, None), (None, [1.0, 1.0])], "qid int, dense array<double>")
    got = [tuple(r) for r in dense.search_dense(corpus, queries, 5).orderBy("rank").collect()]
    assert got == [(7, 1, 1.0, 1), (7, 1, 1.0, 2), (7, 3, 4.0, 3)]
    assert [r.chunk_id for r in dense.search_dense(corpus, queries, 5, {"kind": "b"}).collect()] == [3]
    for c, q, k in [(corpus, queries, 0), (corpus.where("false"), queries, 3), (corpus, queries.where("false"), 3)]:
        assert dense.search_dense(c, q, k).count() == 0
    with pytest.raises(Exception, match="vectors of length 2 and queries of length 3"):
        dense.search_dense(corpus, queries.withColumn("dense", F.array_append("dense", F.lit(0.0))), 3).collect()
