"""The stand-in embedder gives each word of a long text its vector."""

from lodestone.operators import models


def test_all_words_have_vectors(spark):
    texts = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(500))), (1, ""), (2, None)], "id long, text string")
    rows = {r.id: r.vecs for r in models.LexicalEmbedder(8).embed(texts, "id", "text").collect()}
    assert len(rows[0]) == 500 and rows[1] == rows[2] == []
    (late,) = models.LexicalEmbedder(8).embed(spark.createDataFrame([(3, "w499")], "id long, text string"), "id", "text").collect()
    assert rows[0][499] == late.vecs[0] and rows[0][0] != late.vecs[0]
