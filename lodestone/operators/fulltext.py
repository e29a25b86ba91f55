"""Full-text search over postings: BM25 scores and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sparse import WORD, hot_tokens


def lengths_of(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """chunk_id and n_words of each text; 0 for one without words or a null one."""
    return texts.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.regexp_count(F.lower(F.col(text_col)), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))


def all_one(frequencies: DataFrame) -> DataFrame:
    """token, df and an idf of 1: for postings whose weights hold it already."""
    return frequencies.select("token", "df", F.lit(1.0).alias("idf"))


def bm25_idf(frequencies: DataFrame, lengths: DataFrame) -> DataFrame:
    """token, df and idf, the part of BM25 that a token has alone. lengths: chunk_id, n_words of all chunks."""
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return frequencies.crossJoin(F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n")))).select("token", "df", part.alias("idf"))


def bm25_weights(postings: DataFrame, lengths: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """chunk_id, token and weight, the rest of BM25, from a posting and its chunk's length: search them with `search_sparse`
    and `bm25_idf`, so that no posting meets its token's frequency. Lengths are dealt by chunk once, for both their uses."""
    tf, dealt = F.col("weight"), lengths.select("chunk_id", "n_words").repartition("chunk_id")
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_words") / F.col("mean")))
    rows = postings.select("chunk_id", "token", "weight").join(dealt, "chunk_id")
    return rows.crossJoin(F.broadcast(dealt.agg(F.avg("n_words").alias("mean")))).select("chunk_id", "token", part.alias("weight"))


def bm25_postings(postings: DataFrame, lengths: DataFrame, frequencies: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """chunk_id, token and weight, the whole BM25 part of each posting: search them with `search_sparse` and `all_one`.

    lengths: chunk_id, n_words of all chunks, those without words too; frequencies: token, df.
    """
    # Frequent words are few, and their frequencies are broadcast; the rest can't make a hot key.
    rows = _with_frequency(bm25_weights(postings, lengths, k1, b), frequencies)
    n = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n")))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("weight")
    return rows.crossJoin(n).select("chunk_id", "token", part.alias("weight"))


def _with_frequency(rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The rows with their token's df. Tokens of more than DEALT chunks join by a broadcast: their number is less than the
    postings' over DEALT, and its bound grows with the postings beyond MOST_HOT of them."""
    hot = F.broadcast(hot_tokens(frequencies).select("token", F.col("df").alias("hot_df")))
    marked = rows.join(hot, "token", "left")
    rare = marked.where("hot_df IS NULL").drop("hot_df").join(frequencies.select("token", "df"), "token")
    return rare.unionByName(marked.where("hot_df IS NOT NULL").withColumnRenamed("hot_df", "df"))


def phrase_hits(postings: DataFrame, phrases: DataFrame, frequencies: DataFrame) -> DataFrame:
    """qid, chunk_id and n_hits: how often the words of each phrase stand one after the other in each chunk.

    postings: chunk_id, token, positions; phrases: qid, words (array of tokens; null or empty ones have no hits);
    frequencies: token, df. Give the postings of the phrases' words alone where they are at hand. A phrase's rarest word names the chunks to look at; its other words are joined by word and
    chunk together, so a word of all chunks is looked up for those chunks alone.
    """
    words = phrases.where(F.size("words") > 0).select("qid", F.size("words").alias("n"), F.posexplode("words").alias("i", "token"))
    known = words.join(frequencies.select("token", "df"), "token")
    rarest = known.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("df", "i"))).where("at = 1").select("qid", "token")
    candidates = rarest.join(postings.select("token", "chunk_id"), "token").select("qid", "chunk_id")
    placed = candidates.join(words, "qid").join(postings.select("token", "chunk_id", "positions"), ["token", "chunk_id"])
    starts = placed.select("qid", "chunk_id", "n", "i", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
    grouped = starts.groupBy("qid", "chunk_id", "n").agg(F.collect_list("starts").alias("each")).where(F.size("each") == F.col("n"))
    common = F.aggregate(F.slice("each", 2, F.greatest(F.size("each") - 1, F.lit(0))), F.col("each")[0], lambda a, x: F.array_intersect(a, x))
    return grouped.select("qid", "chunk_id", F.size(common).cast("long").alias("n_hits")).where("n_hits > 0")
