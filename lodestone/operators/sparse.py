"""Inverted-index scoring over a table of postings (chunk_id, token, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparse_blocks import WORD, search_blocks


def word_postings(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """chunk_id, token and weight: how often each lower-cased word stands in each text."""
    words = texts.select(F.col(id_col).alias("chunk_id"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({WORD})"), F.lit(1))).alias("token"))
    return words.groupBy("chunk_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def asked_postings(texts: DataFrame, asked: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """As `word_postings`, of the asked tokens (token) alone, dealt by chunk: other words don't leave the task that reads
    their text, and what is computed by chunk needs no other shuffle. Texts are split once, whoever reads the result.

    The distinct asked tokens are broadcast: a part of the vocabulary, which grows far slower than texts or queries.
    """
    rows = texts.select(F.col(id_col).alias("chunk_id"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({WORD})"), F.lit(1))).alias("token"))
    words = rows.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").repartition("chunk_id")
    return words.groupBy("chunk_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def split_texts(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """chunk_id and words: the lower-cased words of each text, where the text lies. Texts of one id are one chunk: only those
    ids are looked for beforehand, over ids alone, and only their texts are brought together."""
    split = texts.select(F.col(id_col).alias("chunk_id"), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    often = texts.select(F.col(id_col).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    if not often.limit(1).count():
        return split
    same = F.col("chunk_id").eqNullSafe(F.col("_id"))
    again = split.join(often, same, "left_semi").groupBy("chunk_id").agg(F.flatten(F.collect_list("words")).alias("words"))
    return split.join(often, same, "left_anti").unionByName(again)


def split_frequency(split: DataFrame, asked: DataFrame) -> DataFrame:
    """token, df of the asked tokens (token) in split texts: tasks count what they read, and shuffle their counts alone."""
    each = split.select(F.explode(F.array_distinct("words")).alias("token"))
    return each.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def split_idf(split: DataFrame, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """As `idf_scores`, of the asked tokens (token) in split texts."""
    return split_frequency(split, asked).crossJoin(F.broadcast(document_count(documents))).select("token", "df", idf_of().alias("idf"))


def postings_of(split: DataFrame, asked: DataFrame) -> DataFrame:
    """As `asked_postings`, from split texts."""
    words = split.select("chunk_id", F.explode("words").alias("token")).join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    return words.repartition("chunk_id").groupBy("chunk_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def positioned_postings(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """As `word_postings`, with positions: where in the text the word stands, counted in words from 0. With a table of asked
    tokens (token), of these alone: they are broadcast, and no other word is shuffled."""
    words = texts.select(F.col(id_col).alias("chunk_id"), F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({WORD})"), F.lit(1))).alias("pos", "token"))
    if asked is not None:
        words = words.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    return words.groupBy("chunk_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sort_array(F.collect_list("pos")).alias("positions"))


def exploded(vectors: DataFrame, id_col: str = "chunk_id", map_col: str = "sparse") -> DataFrame:
    """Postings of sparse vectors kept as maps from token to weight. Spark would ask a plain `explode` beforehand whether its
    map is empty, and compute the map once more for that, for expressions of words even once for each word."""
    return vectors.select(F.col(id_col).alias("chunk_id"), F.explode_outer(map_col).alias("token", "weight")).where("token IS NOT NULL").withColumn("weight", F.col("weight").cast("double"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """token, df. A chunk holds a token once, as postings are kept by replacement."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def document_count(documents: DataFrame) -> DataFrame:
    """n: how many chunks there are, with postings or without."""
    return documents.select("chunk_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def idf_of() -> Column:
    """The inverse frequency from the columns n and df."""
    return F.log((F.col("n") + 1).cast("double") / (F.col("df") + 1)) + 1


def idf_scores(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """token, df and idf = ln((N + 1) / (df + 1)) + 1; N counts the indexed documents, those without postings too."""
    return document_frequency(postings).crossJoin(F.broadcast(document_count(documents))).select("token", "df", idf_of().alias("idf"))


#: Postings of one token that one task joins; those of a more frequent one are dealt to several.
DEALT = 1_000_000
#: Tokens that count as frequent, at most: a token of more than a hundred thousandth of all postings is one of few.
MOST_HOT = 100_000


def hot_tokens(frequencies: DataFrame) -> DataFrame:
    """token, df and copies of the tokens (token, df) whose postings are dealt to several tasks.

    They have more than DEALT postings, and more than a share of 1 / MOST_HOT of all postings, so there are never as many
    as MOST_HOT of them: small enough to broadcast, whatever the corpus.
    """
    total = frequencies.agg(F.sum("df").alias("total"))
    most = F.greatest(F.lit(DEALT), F.col("total") / MOST_HOT)
    few = frequencies.select("token", "df").crossJoin(F.broadcast(total)).where(F.col("df") > most)
    return few.select("token", "df", F.ceil(F.col("df") / most).cast("int").alias("copies"))


def scored_hits(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """qid, chunk_id and score: the sum of q_weight * weight * idf over the common tokens of queries and chunks.

    weights: qid, token, q_weight, idf (null: 1) and df (null: none). A frequent token's postings are dealt to several
    tasks by chunk, and its few query rows are copied to each.
    """
    score = F.sum(F.col("q_weight") * F.col("weight") * F.coalesce("idf", F.lit(1.0))).alias("score")
    # The asked tokens alone are looked at; a token's df is one, whoever asks.
    hot = hot_tokens(weights.groupBy("token").agg(F.max(F.coalesce("df", F.lit(0))).alias("df")))
    hot = hot.select("token", "copies")
    dealt = postings.join(F.broadcast(hot), "token", "left").withColumn("copy", F.expr("CAST(pmod(xxhash64(chunk_id), coalesce(copies, 1)) AS int)")).drop("copies")
    copied = weights.join(F.broadcast(hot), "token", "left").withColumn("copy", F.explode(F.expr("sequence(0, coalesce(copies, 1) - 1)"))).drop("copies", "df")
    return dealt.join(copied, ["token", "copy"]).groupBy("qid", "chunk_id").agg(score)


def top_hits(scored: DataFrame, top_k: int) -> DataFrame:
    """qid, chunk_id, sparse_score (six decimals) and rank of each query's top_k; ties go by id."""
    order = Window.partitionBy("qid").orderBy(F.desc("sparse_score"), "chunk_id")
    rounded = scored.select("qid", "chunk_id", F.round("score", 6).alias("sparse_score"))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(top_k, 0))


#: Rows of the queries up to which their blocks are broadcast to split texts (about 20 MB).
FEW = 1 << 19


def search_sparse(postings: DataFrame, idf: DataFrame, queries: DataFrame, top_k: int, chunks: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, sparse_score (sum of query weight * weight * idf, six decimals) and rank of the top_k chunks.

    queries: qid, token, weight. A token without an idf counts with 1. `chunks`
    (chunk_id), if given, are those that exist: others are dropped after the cut to top_k and the rest is ranked anew.
    `allowed` (chunk_id), if given, are those that a filter lets through: only they are scored and cut. The query's tokens
    meet the idf first; then blocks of queries meet blocks of chunks (see `search_blocks`), so no row is made for a pair.
    Give the postings of the asked tokens alone (`asked_postings`) where they are at hand, or split texts (`split_texts`:
    chunk_id, words): where the queries are few, these are scored where they lie, and no posting is shuffled.
    """
    inverse = F.coalesce("idf", F.lit(1.0))
    weights = queries.select("qid", "token", F.col("weight").alias("q_weight")).join(idf.select("token", "idf"), "token", "left")
    if allowed is not None:
        postings = postings.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    if "words" in postings.columns and queries.limit(FEW + 1).count() > FEW:
        postings = postings_of(postings, queries)
    best = search_blocks(postings, weights.select("qid", "token", (F.col("q_weight") * inverse).alias("weight")), top_k)
    if chunks is None:
        return best
    kept = best.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return top_hits(kept.select("qid", "chunk_id", F.col("sparse_score").alias("score")), top_k)


def without(postings: DataFrame, removed: DataFrame) -> DataFrame:
    """The postings of other chunks than the removed ones (chunk_id)."""
    return postings.join(removed.select("chunk_id"), "chunk_id", "left_anti")


def replaced(postings: DataFrame, fresh: DataFrame, fresh_ids: DataFrame) -> DataFrame:
    """The postings after delete and insert of the fresh chunks; one without any token leaves no posting."""
    return without(postings, fresh_ids).unionByName(fresh)


def token_bucket(token: Column, buckets: int) -> Column:
    """Which of the buckets holds a token's postings; stored postings are partitioned by it, so that a reader of few
    tokens opens few of their folders."""
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def frequency_changes(added: DataFrame, removed: DataFrame) -> DataFrame:
    """token and change: by how much postings (chunk_id, token) that come and go change each document frequency."""
    counts = [rows.groupBy("token").agg((F.count(F.lit(1)) * sign).alias("change")) for rows, sign in ((added, 1), (removed, -1))]
    return counts[0].unionByName(counts[1]).groupBy("token").agg(F.sum("change").alias("change")).where("change <> 0")


def idf_of_changes(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """token, df and idf as `idf_scores`, from all changes of the document frequencies (token, change): no posting is read."""
    counted = changes.groupBy("token").agg(F.sum("change").alias("df")).where("df > 0")
    return counted.crossJoin(F.broadcast(document_count(documents))).select("token", "df", idf_of().alias("idf"))
