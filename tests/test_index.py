"""The posting index, its searches, BM25 and phrases against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext, index as ix, sparse

WORDS = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 30]))) for i in range(120)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def built(spark, texts, tmp_path_factory):
    """Three batches: all with other texts of some, these again as they should be, and one more that is taken out again."""
    index = ix.PostingIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=5)
    index.create()
    assert index.next_batch() == 0
    index.add(0, frame(spark, {k: "old " + t if k % 4 == 0 else t for k, t in texts.items()}))
    assert index.next_batch() == 1
    counts = index.add(1, frame(spark, {**{k: t for k, t in texts.items() if k % 2 == 0}, 999: "the end"}))
    assert counts["indexed"] == 31 and counts["replaced"] == 30
    counts = index.add(2, frame(spark, {}), spark.createDataFrame([(999,), (12345,)], "chunk_id long"))
    assert counts["removed"] == 1 and counts["indexed"] == counts["replaced"] == 0
    return index


def test_frequencies_follow_changes(spark, built, texts):
    df = {}
    for t in texts.values():
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    got = {r.token: r for r in built.idf().collect()}
    assert {w: r.df for w, r in got.items()} == df
    assert all(r.idf == pytest.approx(math.log((len(texts) + 1) / (r.df + 1)) + 1) for r in got.values())
    most = {w: max(t.split().count(w) for t in texts.values()) for w in df}
    assert all(r.most >= most[w] for w, r in got.items())
    assert {(r.chunk_id, r.token, tuple(r.positions)) for r in built.postings().collect()} == {(k, w, tuple(i for i, x in enumerate(t.split()) if x == w)) for k, t in texts.items() for w in t.split()}


def plain_top(texts, queries, k):
    n = len(texts)
    df = {w: sum(w in t.split() for t in texts.values()) for w in set(WORDS)}
    out = {}
    for qid, q in queries.items():
        scores = {}
        for c, t in texts.items():
            s = sum(weight * t.split().count(w) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, weight in q.items() if w in t.split())
            if s:
                scores[c] = round(s, 6)
        for rank, c in enumerate(sorted(scores, key=lambda c: (-scores[c], c))[:k], 1):
            out[qid, rank] = (c, scores[c])
    return out


@pytest.mark.parametrize("late", [0, 10, 60, 10**6])
@pytest.mark.parametrize("k", [1, 5, 50])
def test_late_tokens_change_nothing(spark, built, texts, late, k):
    """Whatever counts as late: queries of late words alone, of none, and of both."""
    queries = {1: {"the": 1.0}, 2: {"w1": 1.0, "the": 1.0}, 3: {"w1": 2.0, "w2": 1.0}, 4: {"w3": 50.0, "w4": 40.0, "the": 0.5, "of": 0.5}, 5: {"nowhere": 1.0}, 6: {w: 1.0 for w in set(WORDS)}}
    rows = spark.createDataFrame([(q, w, x) for q, ws in queries.items() for w, x in ws.items()], "qid long, token string, weight double")
    got = {(r.qid, r["rank"]): (r.chunk_id, r.sparse_score) for r in ix.search_index(built, rows, k, late).collect()}
    want = plain_top(texts, queries, k)
    assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()}
    assert all(got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)


def test_search_opens_few_buckets(spark, built):
    asked = spark.createDataFrame([(1, "w1", 1.0)], "qid long, token string, weight double")
    plan = ix.search_index(built, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:=|IN)", plan)) >= 1


def test_frequent_words_are_dealt(spark, monkeypatch):
    """A word of all chunks: no task of the join gets more than its share, and scores stay."""
    chunks = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("the w"), (F.col("id") % 100).cast("string")).alias("text"))
    words = sparse.word_postings(chunks)
    idf = sparse.idf_scores(words, chunks)
    asked = spark.createDataFrame([(1, "the", 1.0), (1, "w7", 1.0), (2, "the", 2.0)], "qid long, token string, weight double")
    want = sorted(map(tuple, sparse.search_sparse(words, idf, asked, 30).collect()))
    monkeypatch.setattr(sparse, "DEALT", 1000)
    hot = sparse.hot_tokens(idf).collect()
    assert [(r.token, r.copies) for r in hot] == [("the", 20)]
    assert sorted(map(tuple, sparse.search_sparse(words, idf, asked, 30).collect())) == want
    dealt = words.where("token = 'the'").select(F.expr("CAST(pmod(xxhash64(chunk_id), 20) AS int)").alias("copy")).groupBy("copy").count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < 1300


def test_few_tokens_are_frequent(spark, monkeypatch):
    """The list that is broadcast has a bound, whatever the frequencies."""
    monkeypatch.setattr(sparse, "DEALT", 1)
    monkeypatch.setattr(sparse, "MOST_HOT", 50)
    rng = random.Random(2)
    for df in ([5] * 500, [rng.randrange(1, 10**6) for _ in range(500)], [2**i for i in range(50)] * 3, []):
        rows = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(df)], "token string, df long")
        assert sparse.hot_tokens(rows).count() < 50


def test_bm25(spark, texts):
    chunks = frame(spark, texts)
    words = sparse.word_postings(chunks)
    df = sparse.document_frequency(words)
    got = {(r.chunk_id, r.token): r.weight for r in fulltext.bm25_postings(words, fulltext.lengths_of(chunks), df).collect()}
    mean = sum(len(t.split()) for t in texts.values()) / len(texts)
    for c, t in texts.items():
        for w in set(t.split()):
            n, tf = sum(w in x.split() for x in texts.values()), t.split().count(w)
            part = math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / mean))
            assert got.pop((c, w)) == pytest.approx(part)
    assert not got


def test_phrases(spark, texts):
    placed = sparse.positioned_postings(frame(spark, texts))
    asked = {1: ["the", "of"], 2: ["the", "the", "the"], 3: ["w1"], 4: ["w1", "nowhere"], 5: [], 6: ["of", "the", "of", "the"], 7: None}
    phrases = spark.createDataFrame(list(asked.items()), "qid long, words array<string>")
    got = {(r.qid, r.chunk_id): r.n_hits for r in fulltext.phrase_hits(placed, phrases, sparse.document_frequency(placed)).collect()}
    want = {}
    for q, p in asked.items():
        for c, t in texts.items():
            w = t.split()
            n = sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)) if p else 0
            if n:
                want[q, c] = n
    assert got == want


def test_empty_tables(spark, tmp_path):
    index = ix.PostingIndex(spark, str(tmp_path / "index")).create()
    asked = spark.createDataFrame([(1, "a", 1.0)], "qid long, token string, weight double")
    assert index.idf().count() == index.postings().count() == ix.search_index(index, asked, 3).count() == 0
    index.add(0, spark.createDataFrame([(1, None), (2, " "), (None, "a")], "chunk_id long, text string"))
    assert index.current().count() == 2 and index.idf().count() == 0
    assert ix.search_index(index, asked.where("false"), 3).count() == 0
