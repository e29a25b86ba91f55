"""Sparse search over split texts: the same hits as over postings, and no posting is shuffled."""

from lodestone.operators import sparse, sparse_blocks
from lodestone.plans import retrieval

from .test_sparse_blocks import texts_of


def asked(spark):
    return spark.createDataFrame([(q, t, 1.0) for q in range(6) for t in (f"w{q}", f"w{q + 9}", "the", "nowhere")], "qid long, token string, weight double")


def both(texts, q):
    words, split = sparse.word_postings(texts), sparse.split_texts(texts)
    want = sparse.search_sparse(words, sparse.idf_scores(words, texts), q, 7).collect()
    return sorted(map(tuple, want)), sparse.search_sparse(split, sparse.split_idf(split, q, texts), q, 7)


def test_hits_are_those_of_postings(spark, monkeypatch):
    rows, texts = texts_of(spark, 200)
    odd = texts.unionByName(spark.createDataFrame([(3, "the w1"), (3, "w1 of"), (None, "w2 the"), (None, "the"), (900, None), (901, " "), (902, "W3 the THE")], "chunk_id long, text string"))
    for table in (texts, odd, texts.where("false")):
        for entries, few in ((1 << 17, 1 << 19), (40, 1 << 19), (1 << 17, 3)):
            monkeypatch.setattr(sparse_blocks, "BLOCK_ENTRIES", entries)
            monkeypatch.setattr(sparse, "FEW", few)
            want, got = both(table, asked(spark))
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_texts_stay_where_they_lie(spark, tmp_path):
    _, texts = texts_of(spark, 50)
    texts.write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    q = asked(spark)
    split = sparse.split_texts(texts)
    plan = sparse_blocks._packed_texts(split, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    queries = retrieval.Queries(spark.createDataFrame([(0, "the w1", [0.0])], "qid long, text string, dense array<float>"), q.where("qid = 0"))
    index = retrieval.Index(spark.createDataFrame([(1, "x", [0.0])], "chunk_id long, text string, dense_vector array<float>"), split, sparse.split_idf(split, q, texts), None, texts.select("chunk_id"), texts)
    found = retrieval.with_chunks(retrieval.hybrid(index, queries, 3), index)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "text#" in x and "chunk_id#" in x)
    above = [x for x in lines[max(0, at - 4) : at]]
    assert not any("Exchange hashpartitioning(chunk_id" in x for x in above)


def test_postings_of_an_index_are_placed_where_texts_lie(spark, monkeypatch):
    _, texts = texts_of(spark, 60)
    odd = texts.unionByName(spark.createDataFrame([(900, None), (901, " "), (902, "W3 the THE x_1"), (None, "w3")], "chunk_id long, text string"))
    want = sorted(map(tuple, sparse.positioned_postings(odd).collect()), key=repr)
    for entries in (1 << 17, 7, 30):
        monkeypatch.setattr(sparse_blocks, "BLOCK_ENTRIES", entries)
        assert sorted(map(tuple, sparse_blocks.placed_postings(odd).collect()), key=repr) == want
    assert "Exchange" not in sparse_blocks.placed_postings(texts)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_reranked_rows_stay_where_they_lie(spark, tmp_path):
    """Also where no table is small enough that Spark would broadcast it unasked."""
    _, texts = texts_of(spark, 50)
    texts.write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    q = asked(spark).where("qid = 0")
    split = sparse.split_texts(texts)
    queries = retrieval.Queries(spark.createDataFrame([(0, "the w1", [0.0])], "qid long, text string, dense array<float>"), q)
    index = retrieval.Index(spark.createDataFrame([(1, "x", [0.0])], "chunk_id long, text string, dense_vector array<float>"), split, sparse.split_idf(split, q, texts), None, texts.select("chunk_id"), texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (retrieval.search_code_examples(index, queries, None, 3), retrieval.search_documentation(index, queries, None, 3), retrieval.with_chunks(retrieval.hybrid(index, queries, 3), index)):
            lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
            depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
            scans = [i for i, x in enumerate(lines) if "FileScan" in x and "text#" in x and "chunk_id#" in x]
            # Above each scan of texts, the first join or exchange is a join with what was broadcast.
            joined = []
            for i in scans:
                above, at = [], depth(lines[i])
                for line in reversed(lines[:i]):
                    if depth(line) < at:
                        at = depth(line)
                        above.append(line)
                joined.append(next(x for x in above if "Join" in x or "Exchange" in x))
            assert scans and all("Broadcast" in x for x in joined), joined
            assert found.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
