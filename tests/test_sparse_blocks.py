"""Sparse search by blocks: against a plain version, and what it makes of its plan."""

from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import fulltext, sparse, sparse_blocks


def texts_of(spark, n):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 9)) + (" the" * (i % 5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id long, text string")


def test_many_blocks_are_equal_to_a_plain_version(spark, monkeypatch):
    rows, texts = texts_of(spark, 300)
    asked = [(q, t, float(w)) for q in range(20) for t, w in ((f"w{q}", 2), (f"w{q + 9}", 1), ("the", 1), ("nowhere", 1))]
    queries = spark.createDataFrame(asked, "qid long, token string, weight double").repartition(3)
    words = sparse.asked_postings(texts, queries)
    assert {r.token for r in words.select("token").distinct().collect()} <= {t for _, t, _ in asked}
    idf = sparse.idf_scores(words, texts)
    value = {r.token: r.idf for r in idf.collect()}
    want = []
    for q in range(20):
        scores = []
        for i, text in rows:
            count = Counter(text.split())
            if any(count[t] for p, t, _ in asked if p == q):
                scores.append((-round(sum(w * count[t] * value.get(t, 1.0) for p, t, w in asked if p == q), 6), i))
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scores)[:7])]
    for dense in (1 << 30, 0):  # all by products, none by products
        monkeypatch.setattr(sparse_blocks, "DENSE", dense)
        monkeypatch.setattr(sparse_blocks, "BLOCK_ENTRIES", 50)
        monkeypatch.setattr(sparse_blocks, "PAIRS", 10)
        assert sorted(map(tuple, sparse.search_sparse(words, idf, queries, 7).collect())) == sorted(want)


def test_weights_of_nothing_or_less_still_make_hits(spark):
    postings = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.0), ("c", "y", -1.0), ("d", "z", 1.0)], "chunk_id string, token string, weight double")
    q = spark.createDataFrame([(0, "x", 1.0), (0, "y", 1.0)], "qid long, token string, weight double")
    none = spark.createDataFrame([], "token string, idf double")
    got = sparse.search_sparse(postings, none, q, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.sparse_score) for r in got] == [("a", 1.0), ("b", 0.0), ("c", -1.0)]


def test_no_row_is_made_for_a_pair_and_only_asked_words_are_dealt(spark):
    _, texts = texts_of(spark, 50)
    q = spark.createDataFrame([(0, "the", 1.0)], "qid long, token string, weight double")
    words = sparse.asked_postings(texts, q)
    plan = sparse.search_sparse(words, sparse.idf_scores(words, texts), q, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "copy" not in plan and "LeftSemi" in plan
    assert words.select(F.sum("weight")).first()[0] == sum(i % 5 for i in range(50))


def test_bm25_in_two_parts_is_the_whole(spark):
    _, texts = texts_of(spark, 60)
    words, lengths = sparse.word_postings(texts), fulltext.lengths_of(texts)
    df = sparse.document_frequency(words)
    whole = {(r.chunk_id, r.token): r.weight for r in fulltext.bm25_postings(words, lengths, df).collect()}
    parts = fulltext.bm25_weights(words, lengths).join(fulltext.bm25_idf(df, lengths), "token").collect()
    assert len(parts) == len(whole) and all(abs(whole[r.chunk_id, r.token] - r.weight * r.idf) < 1e-12 for r in parts)


def test_partitions_of_chunks_are_few_and_near_floors_count(spark):
    import numpy as np

    postings = spark.createDataFrame([(i, f"t{i % 3}", 1.0) for i in range(50)], "chunk_id long, token string, weight double")
    queries = spark.createDataFrame([(1, "t0", 2.0), (2, "t1", 1.0)], "qid long, token string, weight double")
    found = sparse_blocks.search_blocks(postings, queries, 2)
    assert f", {2 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2.0, 1), (1, 3, 2.0, 2), (2, 1, 1.0, 1), (2, 4, 1.0, 2)]
    # After a first block has set the floors, what rounds up to one still counts, and what doesn't share a token never does.
    best = sparse_blocks._Best(1, 2)
    ids = np.array([5, 6, 7], dtype=object)
    best.see(ids, np.array([[1.0, 0.5, 0.0]]), np.array([[True, True, False]]))
    best.see(ids + 10, np.array([[0.4999996, 0.4999994, 0.9]]), np.array([[True, True, False]]))
    assert sorted(zip(best.found.tolist(), best.score.tolist())) == [(5, 1.0), (6, 0.5), (15, 0.5)]
