"""The registered language model query looks at more than one word of context."""

import zlib

from pyspark.sql import functions as F

from lodestone.llm import lm_scoring, queries


def test_two_words_of_context(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    rows = [(i, "a x p" if k % 2 else "b x q") for k, i in enumerate(train)] + [(held[0], "a x p"), (held[1], "a x q")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = {r.doc_id: r.score for r in queries.op1(spark, str(tmp_path)).collect()}
    assert len(score) == len(rows) and score[held[0]] > score[held[1]] + 0.1


def test_requests_leave_the_disk(spark):
    """The shards' requests are the largest shuffle: when the answers are staged, none of them is left."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getPath(): f.length() for f in (files.getAllFiles().apply(i) for i in range(files.getAllFiles().size())) if f.getName().endswith(".data")}
    docs = spark.range(300).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 400), i -> hex(xxhash64(id, i))), ' ') AS text")
    before = held()
    scored = lm_scoring.score(docs, F.expr("doc_id % 7 = 2"), order=3)
    assert sum(n for path, n in held().items() if path not in before) < 500_000  # all requests are some 2 MB
    assert scored.count() == 300
