"""Scores of texts under an n-gram model of the corpus, kept in sharded Elias-Fano tries."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import dropped, shuffles_deleted, small_batches, staged, word_hashes
from .ngram_trie import CHILD_BITS, STEP, Trie, code, mapped

#: Tokens of a batch, the unit that asks shards for counts; nodes that a shard is to hold, over all batches.
BATCH_TOKENS, SHARD_NODES = 1 << 20, 1 << 20
#: A word that begins at least this share of all n-grams is dealt to SALTS shards by its next word. At most 1000 words.
HOT_SHARE, SALTS = 1 / 1000, 32
#: Parts that the shards are asked in, and that batches meet their answers in, one after the other: one part's requests or
#: answers are shuffled, and so lie on disk, at a time.
ROUNDS = 2
START, END = xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b"", 2)


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the text's tokens: words of the A-Z lower-cased text, parted by ASCII white space, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter([*map(word_hashes.__getitem__, words), END], dtype=np.uint64, count=len(words) + 1)


def _shrunk(tokens: np.ndarray) -> bytes:
    """Compressed, byte by byte of all tokens: high bytes are nearly all alike."""
    return zstandard.compress(tokens.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 3)


def _grown(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), "u1").reshape(4, -1).T).view("<i4").ravel()


def _tokenised(df: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """batch, doc_ids, held, lengths, vocabulary (hashes, frequent ones first), tokens (places in it, compressed), hot (its frequent words)."""

    def batch_of(docs: list, held: list, found: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(f) for f in found], dtype="<u4")
        words, tokens, counts = np.unique(np.concatenate([np.array([START], np.uint64), *found]), return_inverse=True, return_counts=True)
        tokens = tokens[1:]
        counts[words == np.uint64(START)] = len(docs)
        # Kept by how often they come: the places of frequent words are small, and so compress.
        by = np.argsort(-counts, kind="stable")
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        words, tokens, counts = words[by], rank[tokens], counts[by]
        often = (counts >= HOT_SHARE / 2 * len(tokens)) & (words != np.uint64(END))
        hot = [{"word": w, "n": n} for w, n in zip(words[often].view(np.int64).tolist(), counts[often].tolist())]
        values = ([docs], [held], [lengths.tobytes()], [words.astype("<u8").tobytes()], [_shrunk(tokens)], [len(words)], [len(tokens)], [int(lengths[~np.array(held)].sum())], [hot])
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=["doc_ids", "held", "lengths", "words", "tokens", "n_words", "n_tokens", "n_train", "hot"])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, found, size = [], [], [], 0
        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs.append(doc)
                held.append(out)
                found.append(token_hashes(text.as_py() or ""))
                size += len(found[-1])
                if size >= BATCH_TOKENS:
                    yield batch_of(docs, held, found)
                    docs, held, found, size = [], [], [], 0
        if docs:
            yield batch_of(docs, held, found)

    schema = "doc_ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, n_words long, n_tokens long, n_train long, hot array<struct<word: long, n: long>>"
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    return staged(texts.mapInArrow(tokenise, schema).withColumn("batch", F.monotonically_increasing_id()), "lm-batches", rows_a_file=1)


def _distinct(path: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of the numbers, which have that many bits, and each number's place among them. Where they fit, the
    numbers are sorted with their positions in their low bits: no second array is sorted along."""
    low = max(len(path) - 1, 1).bit_length()
    if bits + low > 63:
        found, where = np.unique(path, return_inverse=True)
        return found, where.astype(np.int32)
    path = (path << low) | np.arange(len(path))
    path.sort()
    at = (path & ((1 << low) - 1)).astype(np.int32)
    path >>= low
    new = np.ones(len(path), dtype=bool)
    np.not_equal(path[1:], path[:-1], out=new[1:])
    where = np.empty(len(path), dtype=np.int32)
    where[at] = np.cumsum(new, dtype=np.int32) - 1
    return path[new], where


class _Grams:
    """The n-grams of a batch as levels of nodes, sorted by shard and path; the same whenever it is made anew.

    A node of level 1 is a word in one shard (a hot word is in several), START included. Deeper nodes are an n-gram's
    last word under the node of what is before it. `at[k]` has the node of each token's n-gram of k + 1 words (that is,
    the token after k words of context), or -1 where the text hasn't so many before it. `keys` and `counts` are made if
    `asking`: to read the answers, the places suffice. Nodes and tokens of a batch are numbers of 32 bits.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray, order: int, shards: int, hot: np.ndarray, asking: bool = True) -> None:
        n = len(tokens)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        start_word = int(np.searchsorted(words, np.uint64(START)))
        is_hot = np.isin(words, hot)
        home = (words % np.uint64(shards)).astype(np.int64)
        salts = min(SALTS, shards)
        salt = ((words >> np.uint64(32)) % np.uint64(salts)).astype(np.int32)
        # Level 1: a row for each word and salt; that of salt 0 answers for the word itself.
        spread = np.where(is_hot, salts, 1)
        offset = np.concatenate([[0], np.cumsum(spread)[:-1]]).astype(np.int32)
        row_word = np.repeat(np.arange(len(words)), spread)
        row_salt = np.arange(len(row_word)) - offset[row_word]
        row_shard = (home[row_word] + row_salt) % shards
        by = np.lexsort((row_word, row_shard))
        place = np.empty(len(by), dtype=np.int32)
        place[by] = np.arange(len(by))
        shard = row_shard[by].astype(np.int32)
        self.asked = np.unique(shard)
        self.cuts = [self._cut(shard)]
        self.keys, self.counts = [], []
        in_train = np.repeat(train, lengths)
        if asking:
            counts = np.bincount(tokens[in_train], minlength=len(words))
            counts[start_word] += int(train.sum())
            self.keys.append(words[row_word[by]])
            self.counts.append(counts[row_word[by]])
        self.parents: list[np.ndarray] = []
        self.at = [place[offset][tokens]]
        word_bits = len(words).bit_length()
        for k in range(1, order):
            # Texts begin with START: the first word's context is START alone, whatever the order.
            parent = np.full(n, -1, dtype=np.int32)
            if k == 1:
                before = np.full(n, start_word, dtype=np.int32)
                before[1:] = tokens[:-1]
                before[starts] = start_word
                parent = place[offset[before] + np.where(is_hot[before], salt[tokens], np.int32(0))]
                del before
            else:
                parent[1:] = self.at[k - 1][:-1]
                parent[starts] = -1
            inside = parent >= 0
            path = (parent[inside].astype(np.int64) << word_bits) | tokens[inside]
            del parent
            found, where = _distinct(path, len(shard).bit_length() + word_bits)
            del path
            node = np.full(n, -1, dtype=np.int32)
            node[inside] = where
            self.at.append(node)
            self.parents.append((found >> word_bits).astype(np.int32))
            if asking:
                self.at[k - 1] = self.at[k - 1][:0]
                self.keys.append(words[found & ((1 << word_bits) - 1)] >> np.uint64(64 - CHILD_BITS))
                self.counts.append(np.bincount(where[in_train[inside]], minlength=len(found)).astype(np.int32))
            shard = shard[self.parents[-1]]
            self.cuts.append(self._cut(shard))

    def _cut(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(shard, self.asked, side="left"), np.searchsorted(shard, self.asked, side="right")

    def slices(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The shards that this batch asks, and in each level where each one's nodes begin and end."""
        return self.asked, self.cuts

    def requests(self, part: int = 0, parts: int = 1) -> Iterator[tuple[int, bytes]]:
        """(shard, nodes): for each shard of that part its nodes' keys, training counts and, below level 1, parents, compressed."""
        asked, cuts = self.slices()
        for i, shard in enumerate(asked.tolist()):
            if shard % parts != part:
                continue
            body = []
            for k, (begins, ends) in enumerate(cuts):
                a, b = int(begins[i]), int(ends[i])
                keys, counts = self.keys[k][a:b], self.counts[k][a:b]
                body += [struct.pack("<Q", b - a), _narrow(counts), keys.astype("<u8").tobytes() if k == 0 else keys.astype("<u8").view("u1").reshape(-1, 8)[:, : CHILD_BITS // 8].tobytes()]
                if k:
                    up = int(cuts[k - 1][0][i])
                    body.append(_narrow(np.bincount(self.parents[k - 1][a:b] - up, minlength=int(cuts[k - 1][1][i]) - up)))
            yield shard, zstandard.compress(b"".join(body), 3)


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each that hold them all."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return struct.pack("<BQ", width, len(values)) + values.astype(f"<u{width}").tobytes()


def _planes(codes: np.ndarray) -> bytes:
    """16-bit codes as their low bytes, then their high ones, which are much alike and so compress."""
    return np.ascontiguousarray(codes.astype("<u2").view("u1").reshape(-1, 2).T).tobytes()


class _Reader:
    def __init__(self, packed: bytes) -> None:
        self.raw, self.at = zstandard.decompress(packed), 0

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def codes(self, n: int) -> np.ndarray:
        return np.ascontiguousarray(self.take("u1", 2 * n).reshape(2, n).T).view("<u2").ravel()

    def narrow(self) -> np.ndarray:
        width, n = struct.unpack_from("<BQ", self.raw, self.at)
        self.at += 9
        return self.take(f"<u{width}", n).astype(np.int64)


def _answers(raws: list[bytes], order: int, weight: float) -> tuple[list[bytes], Trie]:
    """Each batch's answer and the shard's trie.

    All requests' nodes are summed level by level, those seen in training become the trie, and the answers are read
    from it by searching every distinct node.
    """
    readers = [_Reader(raw) for raw in raws]
    levels, lookups, found_in = [], [], []
    up_maps: list[np.ndarray] = []
    up_trained = up_counts = np.zeros(0, dtype=np.int64)
    for k in range(order):
        keys, counts, parents, sizes = [], [], [], []
        for i, r in enumerate(readers):
            n = int(r.take("<u8", 1)[0])
            counts.append(r.narrow())
            if k == 0:
                keys.append(r.take("<u8", n))
            else:
                raw = r.take("u1", n * CHILD_BITS // 8).reshape(n, CHILD_BITS // 8)
                wide = np.zeros((n, 8), dtype="u1")
                wide[:, : raw.shape[1]] = raw
                keys.append(wide.view("<u8").ravel())
                parents.append(np.repeat(up_maps[i], r.narrow()))
            sizes.append(n)
        key, count = np.concatenate(keys).astype(np.uint64), np.concatenate(counts)
        if k == 0:
            node, where = np.unique(key, return_inverse=True)
            parent = np.zeros(len(node), dtype=np.int64)
        else:
            above = np.concatenate(parents)
            if len(up_counts) < 1 << (64 - CHILD_BITS):
                path, where = np.unique(above.astype(np.uint64) << np.uint64(CHILD_BITS) | key, return_inverse=True)
                parent, node = (path >> np.uint64(CHILD_BITS)).astype(np.int64), path & np.uint64((1 << CHILD_BITS) - 1)
            else:
                by = np.lexsort((key, above))
                new = np.concatenate([[True], (np.diff(above[by]) != 0) | (key[by][1:] != key[by][:-1])]) if len(by) else np.zeros(0, bool)
                where = np.empty(len(by), dtype=np.int64)
                where[by] = np.cumsum(new) - 1
                parent, node = above[by][new], key[by][new]
        total = np.bincount(where, weights=count, minlength=len(node)).astype(np.int64)
        seen = np.flatnonzero(total > 0)
        rest = np.log10(weight / (total[seen] + weight))
        share = np.log10(total[seen] + 1.0) if k == 0 else np.log10(total[seen] / (up_counts[parent[seen]] + weight))
        levels.append([node[seen], code(share), code(rest), None])
        if k:
            levels[k - 1][3] = np.searchsorted(np.searchsorted(up_trained, parent[seen]), np.arange(len(up_trained) + 1))
        lookups.append((parent, node))
        found_in.append((total, where, sizes))
        up_maps, up_trained, up_counts = np.split(where, np.cumsum(sizes)[:-1]), seen, total
    trie = mapped(Trie.packed([tuple(x) for x in levels]))
    outs: list[list[bytes]] = [[] for _ in raws]
    places: np.ndarray | None = None
    for k, (parent, node) in enumerate(lookups):
        places = trie.roots(node) if k == 0 else trie.children(k, places[parent], node)
        level, known = trie.levels[k], places >= 0
        share, rest = np.zeros(len(node), dtype="<u2"), np.zeros(len(node), dtype="<u2")
        share[known], rest[known] = level.share[places[known]], level.rest[places[known]]
        if k:
            share[~known] = 65535
        total, where, sizes = found_in[k]
        for i, part in enumerate(np.split(where, np.cumsum(sizes)[:-1])):
            outs[i] += [_planes(share[part]), _planes(rest[part])] if k + 1 < order else [_planes(share[part])]
            if k == 0:
                outs[i].append(_narrow(total[part]))
    return [zstandard.compress(b"".join(x), 3) for x in outs], trie


#: 10 to the power of minus each code; of the greatest, which stands for no probability, 0.
_POWERS = 10.0 ** (-np.arange(1 << 16) / STEP)
_POWERS[65535] = 0.0


def _scores(grams: _Grams, replies: list[bytes], tokens: np.ndarray, lengths: np.ndarray, order: int, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base scores, scores) of a batch's documents from the shards' answers, in shard order."""
    cuts = grams.slices()[1]
    share: list[list[np.ndarray]] = [[] for _ in range(order)]
    rest: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts = []
    for i, raw in enumerate(replies):
        r = _Reader(raw)
        for k in range(order):
            n = int(cuts[k][1][i] - cuts[k][0][i])
            share[k].append(r.codes(n))
            if k + 1 < order:
                rest[k].append(r.codes(n))
            if k == 0:
                counts.append(r.narrow())
    count = np.concatenate(counts)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    sums = lambda x: np.add.reduceat(x, starts)
    at = grams.at[0]
    known = sums((count > 0)[at].astype(np.int64))
    base = sums(np.log10((count + 1) / total)[at])
    p = (10.0 ** (np.concatenate(share[0]).astype(float) / STEP) / total)[at]
    for k in range(1, order):
        own, left = np.concatenate(share[k]), np.concatenate(rest[k - 1])
        node = grams.at[k]
        inside = node >= 0
        deep = node[inside]
        p[inside] = _POWERS[own[deep]] + _POWERS[left[grams.parents[k - 1][deep]]] * p[inside]
    return known, base, sums(np.log10(p))


def score(df: DataFrame, held_out: Column, order: int = 2, weight: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row's whole text.

    Tokens are the words of the A-Z lower-cased text and one end. The model learns from the rows where `held_out` is not
    true: a word has (count + 1) / (N + V + 1), with the training tokens N and distinct words V; after a context it has
    (count after it + weight * probability in the context one word shorter) / (the context's count + weight), so all
    words' probabilities add up to one, but for the rounding of codes to 1/2048 in log10. Texts begin with a start mark
    as context.

    Documents are gathered to batches; a batch asks each shard, by its n-grams' first word, for the distinct n-grams it
    holds, with its own counts; a part of the shards after the other (ROUNDS), and a part's requests leave the disks before
    the next one's are made; so do the answers when batches read them. A shard adds up the counts of all batches, builds its trie and answers from it; no
    task sees more than its shard or batch, and hot first words are split by their second. Every n-gram of the training
    texts counts, none is pruned. Words are told apart by 64 bits of hash (48 below the first).

    A null or empty text is the end alone; a null `held_out` counts as false; a null doc_id stays null; repeated rows
    count each; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    batches = _tokenised(df, held_out, id_col, text_col)
    stats = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    n_words, n_tokens, n_train = map(int, stats)
    shards = max(1, -(-(n_words + (order - 1) * n_tokens) // SHARD_NODES))
    often = batches.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.n").alias("n")).where(F.col("n") >= HOT_SHARE * n_tokens)
    hot = np.array(sorted(r[0] for r in often.select("word").collect()), dtype=np.int64).view(np.uint64)  # at most 1 / HOT_SHARE words

    def grams_of(batch: pa.RecordBatch, i: int, names: list[str], asking: bool) -> tuple[_Grams, np.ndarray, np.ndarray]:
        row = {name: batch.column(k)[i] for k, name in enumerate(names)}
        kept, lengths = np.frombuffer(row["words"].as_py(), "<u8"), np.frombuffer(row["lengths"].as_py(), "<u4").astype(np.int64)
        by = np.argsort(kept)
        place = np.empty(len(by), dtype=np.int32)
        place[by] = np.arange(len(by))
        words, tokens = kept[by], place[_grown(row["tokens"].as_py())]
        train = ~np.array(row["held"].as_py(), dtype=bool)
        return _Grams(words, tokens, lengths, train, order, shards, hot, asking), tokens, lengths

    names = ["batch", "held", "lengths", "words", "tokens"]

    def asked(part: int) -> DataFrame:
        def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for i in range(batch.num_rows):
                    grams, _, _ = grams_of(batch, i, names, True)
                    number = batch.column(0)[i].as_py()
                    for shard, raw in grams.requests(part, ROUNDS):
                        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([number]), pa.array([raw], pa.binary())], names=["shard", "batch", "nodes"])

        return batches.select(*names).mapInArrow(ask, "shard int, batch long, nodes binary")

    def answer(table: pa.Table) -> pa.Table:
        raws = [x.as_py() for x in table.column("nodes")]
        outs, trie = _answers(raws, order, weight)
        shard = table.column("shard")[0].as_py()
        # Words of this shard that are trained and, if hot, at home here: START is no word.
        have = trie.levels[0].keys
        own = (have % np.uint64(shards)).astype(np.int64) == shard
        distinct = int(own.sum()) - int((have[own] == np.uint64(START)).sum())
        return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "reply": pa.array(outs, pa.binary()), "n_distinct": pa.array([distinct] + [0] * (len(outs) - 1), pa.int64())})

    answered = []
    for part in range(ROUNDS):
        with shuffles_deleted(spark), small_batches(spark):
            answered.append(staged(asked(part).groupBy("shard").applyInArrow(answer, "batch long, shard int, reply binary, n_distinct long"), "lm-replies"))
    replies = reduce(DataFrame.unionAll, answered)
    n_distinct = int(replies.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0])
    total = float(n_train + n_distinct + 1)

    columns = ["batch", "doc_ids", "held", "lengths", "words", "tokens", "replies"]

    def joined(part: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("batch"), F.lit(ROUNDS)) == part
        lists = F.transform(F.sort_array(F.collect_list(F.struct("shard", "reply"))), lambda x: x["reply"]).alias("replies")
        return batches.select(*columns[:-1]).where(mine).join(replies.where(mine).groupBy("batch").agg(lists), "batch").select(*columns)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                grams, tokens, lengths = grams_of(batch, i, columns, False)
                known, base, scored = _scores(grams, batch.column(6)[i].as_py(), tokens, lengths, order, total)
                yield pa.record_batch(
                    [pa.array(batch.column(1)[i].as_py(), pa.int64()), pa.array(batch.column(2)[i].as_py(), pa.bool_()), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n_train)), pa.array(base), pa.array(scored)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = []
    for part in range(ROUNDS):
        with shuffles_deleted(spark), small_batches(spark):
            scored.append(staged(joined(part).mapInArrow(finish, kinds), "lm-scores"))
    dropped(batches, *answered)
    return reduce(DataFrame.unionAll, scored)
