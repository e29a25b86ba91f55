"""Near-duplicates by b-bit MinHash: banded candidates, packed signatures, corrected estimates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, key_and_text, n_rows, small_batches, staged, word_hashes

BITS, MINIMA, ROWS = 2, 128, 4
BANDS, WORDS = MINIMA // ROWS, BITS * MINIMA // 64
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Rows of (long, long, long) up to which a list of keys is broadcast (about 50 MB); longer ones are joined by shuffle.
BROADCAST_ROWS = 1 << 21
NO_ID = -(1 << 63)
#: Bands whose buckets are compared first, with their stars alone.
FIRST_BANDS = 4
#: Pairs of one star that meet one copy of its set; a star with more of them is copied.
SPOKES = 1024


class Spec(NamedTuple):
    """Words in a shingle, and the least similarity in hundredths."""

    width: int = 5
    percent: int = 80


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_random = np.random.default_rng(20240229)
_FACTORS = (_random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """The text's set of shingles as sorted 64-bit hashes: A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(word_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words)
    if not n:
        return h
    out = np.zeros(max(1, n - width + 1), dtype=np.uint64)
    for j in range(min(width, n)):
        out = _mixed(out + h[j : j + len(out)] + np.uint64(1))
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of the set under each of MINIMA linear permutations of the 64-bit integers."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 1024):
        part = _FACTORS[:, None] * found[None, a : a + 1024]
        part += _TERMS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return _mixed(least)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into WORDS 64-bit words."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(WORDS, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS minima; bands have keys of their own."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key + column)
    return key


def least_matches(percent: int) -> int:
    """Equal b-bit minima that a pair of at least that similarity has, but for five standard deviations.

    Two unequal minima agree in their low bits by chance, with probability 2**-BITS: of a pair of similarity s, a share
    s + (1 - s) / 2**BITS agrees. Estimates are corrected for that here, once, in the threshold.
    """
    share = percent / 100 + (1 - percent / 100) / 2**BITS
    return int(MINIMA * (share - 5 * (share * (1 - share) / MINIMA) ** 0.5))


def _signed(df: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text_hash, set hash (h1, h2), n, signature words and band keys of every row, staged."""
    sig = [f"s{i}" for i in range(WORDS)]
    names = ["row", "doc_id", "text_hash", "h1", "h2", "n", *sig, "bands"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bands, some = np.zeros((batch.num_rows, 3 + WORDS), dtype=np.uint64), [], []
            for i, text in enumerate(batch.column(3)):
                found = shingles(text.as_py() or "", spec.width)
                if len(found):
                    least, raw = minima(found), found.tobytes()
                    whole[i] = [xxhash.xxh64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1), len(found), *packed(least)]
                    bands.append(band_keys(least).view(np.int64))
                some.append(len(found) > 0)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32))
            columns = [pa.array(np.ascontiguousarray(whole[:, k]).view(np.int64)) for k in range(whole.shape[1])]
            yield pa.record_batch([*batch.columns[:3], *columns, pa.ListArray.from_arrays(ends, flat)], names=names)

    keyed = key_and_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    with small_batches(df.sparkSession):
        return staged(keyed.mapInArrow(sign, schema), "dedup-signatures")


def _often(rows: DataFrame, *key: str) -> DataFrame | None:
    """The keys of more than SPOKES rows, with the copies that the other side of a join gets of them, staged; None if there
    are none."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SPOKES)
    return _some(counted.select(*key, F.expr(f"CAST(ceil(rows / {SPOKES}) AS int)").alias("copies")), "dedup-often")


def _some(rows: DataFrame, name: str) -> DataFrame | None:
    """The rows, staged and counted; None if there are none, so that plans needn't ask for them."""
    found = staged(rows, name, counting=F.lit(True))
    if n_rows(found):
        return found
    dropped(found)
    return None


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if they are few enough."""
    return F.broadcast(rows) if n_rows(rows) <= BROADCAST_ROWS else rows


def _dealt(rows: DataFrame, table: DataFrame, often: DataFrame | None, by: str, *key: str) -> DataFrame:
    """The rows joined with the table's row of their key. The rows of a frequent key (see `_often`) are dealt by another
    column to copies of that row, SPOKES to a copy, so that no task gets a key whole."""
    if often is None:
        return rows.join(table, list(key))
    hot = _small(often)
    dealt = rows.join(hot, list(key), "left").withColumn("copy", F.expr(f"CAST(pmod(xxhash64({by}), coalesce(copies, 1)) AS int)")).drop("copies")
    copied = table.join(hot, list(key), "left").withColumn("copy", F.explode(F.expr("sequence(0, coalesce(copies, 1) - 1)"))).drop("copies")
    return dealt.join(copied, [*key, "copy"]).drop("copy")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of all nodes of the links (a, b), by label spreading and jumping.

    Links and labels stay tables in the shared folder; each round takes a node's least neighbour label, then that
    label's own label, until a round changes nothing.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "dedup-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "dedup-labels")
    stars = _often(both, "b")
    while True:
        near = _dealt(both, labels.select(F.col("node").alias("b"), "label"), stars, "a", "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = staged(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("via")), "dedup-spread")
        # A large component's nodes have one label: they are dealt as well.
        large = _often(spread, "via")
        further = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        new = staged(_dealt(spread, further, large, "node", "via").select("node", "old", F.least("via", "beyond").alias("label")), "dedup-labels", counting=F.expr("old <> label"))
        moved = n_rows(new)
        dropped(labels, spread, large)
        path = new._lodestone_path
        labels = new.drop("old")
        labels._lodestone_path = path
        if not moved:
            dropped(both, stars)
            return labels


def _similar(spec: Spec, inside: Column, n1: Column, n2: Column) -> Column:
    return 100 * inside >= spec.percent * (n1 + n2 - inside)


def _possible(spec: Spec, x: str, y: str) -> Column:
    """No pair of the wanted similarity fails this: shared shingles are at most the lesser core (see `_cores`)."""
    core = F.least(F.col(f"{x}.core"), F.col(f"{y}.core"))
    return _similar(spec, core, F.col(f"{x}.n"), F.col(f"{y}.n"))


def _near(spec: Spec, x: str, y: str) -> Column:
    """Whether the packed signatures agree in as many minima as similar sets do."""
    unequal = [F.expr(f"bit_count(({x}.s{i} ^ {y}.s{i} | shiftrightunsigned({x}.s{i} ^ {y}.s{i}, 1)) & 6148914691236517205)") for i in range(WORDS)]
    return sum(unequal[1:], unequal[0]) <= MINIMA - least_matches(spec.percent)


def _sets(df: DataFrame, wanted: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """node, n, set of the wanted nodes (node, h1, h2, low): only their texts are read again."""
    texts = key_and_text(df, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    keys = wanted.select(F.coalesce("low", F.lit(NO_ID)).alias("key")).distinct()
    small = n_rows(wanted) <= BROADCAST_ROWS
    chosen = texts.join(F.broadcast(keys) if small else keys, "key", "left_semi").select("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or "", spec.width) for t in batch.column(0)]
            hashes = [(xxhash.xxh64_intdigest(f.tobytes()), xxhash.xxh64_intdigest(f.tobytes(), 1)) for f in found]
            h1, h2 = (np.array([h[k] for h in hashes], dtype=np.uint64).view(np.int64) for k in (0, 1))
            yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["h1", "h2", "set"])

    built = chosen.mapInArrow(build, "h1 long, h2 long, set array<long>")
    nodes = wanted.select("node", "h1", "h2")
    matched = built.join(F.broadcast(nodes) if small else nodes, ["h1", "h2"])
    with small_batches(df.sparkSession):
        sets = staged(matched.select("node", F.size("set").cast("long").alias("n"), "set"), "dedup-sets", counting=F.lit(True))
    if n_rows(sets) <= n_rows(wanted):
        return sets
    once = staged(sets.dropDuplicates(["node"]), "dedup-sets")
    dropped(sets)
    return once


def _cores(sets: DataFrame) -> DataFrame:
    """node, core: how many of its shingles some other node has too. Shingles of one node only can't be shared."""
    each = sets.select("node", F.explode("set").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    lonely = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return sets.select("node", "n").join(lonely, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("core"))


def _with_bucket(rows: DataFrame, buckets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows (key, node, ...) joined with their bucket's columns; those of a hot bucket (key, copies) meet copies of them."""
    if hot is None:
        return rows.join(buckets, "key")
    copy = F.expr("CAST(pmod(xxhash64(node), coalesce(copies, 1)) AS int)")
    dealt = rows.join(hot, "key", "left").withColumn("copy", copy).drop("copies")
    copied = buckets.join(hot, "key", "left").withColumn("copy", F.explode(F.expr("sequence(0, coalesce(copies, 1) - 1)"))).drop("copies")
    return dealt.join(copied, ["key", "copy"]).drop("copy")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n1, n2 and inside (shingles that both full sets have) of the pairs (a, b), staged.

    Many pairs may have one b, the star of a large group: they are dealt to copies of its set, SPOKES to a copy.
    """
    pairs = staged(pairs, "dedup-pairs")
    often = _often(pairs, "b")
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("set").alias("set1"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("set").alias("set2"))
    full = _dealt(pairs, two, often, "a", "b").join(one, "a")
    out = staged(full.select("a", "b", "n1", "n2", F.size(F.array_intersect("set1", "set2")).cast("long").alias("inside")), "dedup-overlaps")
    dropped(pairs, often)
    return out


def _confirmed(overlaps: DataFrame, spec: Spec) -> DataFrame:
    """The pairs whose full sets are similar."""
    return overlaps.where(_similar(spec, F.col("inside"), F.col("n1"), F.col("n2"))).select("a", "b")


def _cross_pairs(members: DataFrame, spec: Spec, hot: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may be similar; compared in blocks, each pair of blocks
    in a task of its own, so that no task holds a whole bucket. A pair comes from the first band that its nodes share.

    members: key, band, node, label, n, core, inside (shingles shared with the bucket's star, -1: unknown), signature
    words, bands. Two sets share at most the lesser of their parts inside the star and the lesser of their core's parts
    outside of it; that, the estimate and the sizes decide what is worth a look at the full sets.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    blocks = sizes.select("key", F.expr(f"CAST(ceil(members / {BLOCK}) AS int)").alias("blocks"))
    dealt = _with_bucket(members, blocks, hot).withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"))
    paired = dealt.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "label", "n", "core", "inside", "band", *[f"s{k}" for k in range(WORDS)], "bands")
    ordered = paired.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    need = MINIMA - least_matches(spec.percent)
    half = np.uint64(0x5555555555555555)

    def compare(rows: np.ndarray) -> np.ndarray:
        i, j, block, node, label, n, core, inside = (rows[:, k] for k in range(1, 9))
        band, sig, bands = int(rows[0, 9]), rows[:, 10 : 10 + WORDS].view(np.uint64), rows[:, 10 + WORDS :]
        left = np.flatnonzero(block == i)
        right = left if i[0] == j[0] else np.flatnonzero(block == j)
        out = []
        for a in left.tolist():
            d = sig[a] ^ sig[right]
            unequal = np.bitwise_count((d | (d >> np.uint64(1))) & half).sum(axis=1)
            most = np.minimum(core[a], core[right])
            starred = np.minimum(inside[a], inside[right]) + np.minimum(core[a] - inside[a], core[right] - inside[right])
            most = np.where((inside[a] >= 0) & (inside[right] >= 0), np.minimum(most, starred), most)
            fit = np.flatnonzero((unequal <= need) & (label[right] != label[a]) & (100 * most >= spec.percent * (n[a] + n[right] - most)))
            before = (bands[right[fit], :band] == bands[a, :band]).any(axis=1)
            for b in node[right[fit[~before]]].tolist():
                out.append((min(node[a], b), max(node[a], b)))
        return np.unique(np.array(out, dtype=np.int64).reshape(-1, 2), axis=0)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 10 + WORDS + BANDS), dtype=np.int64)

        def emit(groups: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(groups):
                cuts = np.flatnonzero((np.diff(groups[:, :3], axis=0) != 0).any(axis=1)) + 1
                for group in np.split(groups, cuts):
                    if len(found := compare(np.ascontiguousarray(group))):
                        yield pa.record_batch([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            plain = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:-1]]
            rest = np.concatenate([rest, np.column_stack([*plain, batch.columns[-1].flatten().to_numpy().reshape(-1, BANDS)])])
            last = (rest[:, :3] == rest[-1, :3]).all(axis=1) if len(rest) else np.zeros(0, dtype=bool)
            yield from emit(rest[~last])
            rest = rest[last]
        yield from emit(rest)

    return ordered.mapInArrow(pairs, "a long, b long")


class _Round(NamedTuple):
    """Buckets with nodes of different labels: their members, each one's star, the stars' overlaps, and what to drop."""

    members: DataFrame
    star: DataFrame
    hot: DataFrame | None
    sets: DataFrame
    overlaps: DataFrame
    tables: list[DataFrame | None]


def _compared(df: DataFrame, spec: Spec, id_col: str, text_col: str, signed: DataFrame, nodes: DataFrame, each: DataFrame) -> _Round | None:
    """Compare the members of every bucket of `each` (node, label, band, key) whose nodes have different labels with the
    bucket's star, its most shared node; None if there is no such bucket."""
    sig = [f"s{i}" for i in range(WORDS)]
    full = _some(each.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "members"), "dedup-full")
    if full is None:
        return None
    crowded = _some(full.where(F.col("members") > SPOKES).select("key", F.expr(f"CAST(ceil(members / {SPOKES}) AS int)").alias("copies")), "dedup-crowded")
    hot = None if crowded is None else _small(crowded)
    shared = staged(_with_bucket(each.select("key", "band", "node"), full.select("key"), hot), "dedup-buckets")
    dropped(full)
    wanted = staged(nodes.join(shared.select("node").distinct(), "node"), "dedup-wanted", counting=F.lit(True))
    sets = _sets(df, wanted, spec, id_col, text_col)
    signatures = signed.select(F.col("row").alias("node"), *sig)
    # A node whose core is too small for any partner takes no part.
    about = staged(_cores(sets).where(_similar(spec, F.col("core"), F.col("n"), F.col("core"))).join(signatures, "node"), "dedup-about")
    members = staged(shared.join(about, "node").select("key", "band", "node", "n", "core", *sig), "dedup-members")
    star = members.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("core")).cast("double") / F.col("n"), F.col("node"))).alias("best")).select("key", F.col("best.node").alias("b"))
    spokes = staged(_with_bucket(members.select("key", "node"), star, hot).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "dedup-spokes")
    stars = _often(spokes, "b")
    of_b = about.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("n", "core", *sig)])
    ends = _dealt(spokes, of_b, stars, "a", "b").join(about.alias("x"), F.col("a") == F.col("x.node"))
    both = ends.select("a", "b", F.struct("x.n", "x.core", *[f"x.{c}" for c in sig]).alias("x"), F.struct(*[F.col(f"b_{c}").alias(c) for c in ("n", "core", *sig)]).alias("y"))
    overlaps = _overlaps(both.where(_possible(spec, "x", "y") & _near(spec, "x", "y")).select("a", "b"), sets)
    return _Round(members, star, hot, sets, overlaps, [crowded, shared, wanted, about, spokes, stars, members, sets, overlaps])


def _labelled(df: DataFrame, spec: Spec, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, row and component (row and doc_id of its first member) of every row.

    First the members of the first bands' buckets are compared with their stars: few rows a node, and they link nearly all
    of a large group. Then the buckets of all bands are looked at that still hold nodes of different components.
    """
    signed = _signed(df, spec, id_col, text_col)
    # Equal sets are one node, named by their least row: copies collapse here, however many there are.
    nodes = staged(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "dedup-nodes")
    banded = signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "bands")
    early = banded.select("node", F.col("node").alias("label"), F.posexplode(F.slice("bands", 1, FIRST_BANDS)).alias("band", "key"))
    first = _compared(df, spec, id_col, text_col, signed, nodes, early)
    links = [] if first is None else [_confirmed(first.overlaps, spec)]
    no_labels = df.sparkSession.createDataFrame([], "node long, label long")
    labels = components(links[0]) if links else no_labels
    named = banded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    second = _compared(df, spec, id_col, text_col, signed, nodes, named.select("node", "label", F.posexplode("bands").alias("band", "key")))
    tables = [] if first is None else first.tables
    if second is not None:
        links.append(_confirmed(second.overlaps, spec))
        tables += [*second.tables, labels]
        labels = components(links[0].union(links[1]) if len(links) > 1 else links[0])
        # Then whatever pairs of a bucket are still apart, all of them.
        labelled = second.members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        shares = second.overlaps.select(F.col("a").alias("node"), "b", "inside")
        starred = _with_bucket(labelled, second.star.join(apart, "key"), second.hot).join(shares, ["node", "b"], "left").withColumn("inside", F.when(F.col("node") == F.col("b"), F.col("n")).otherwise(F.coalesce("inside", F.lit(-1))))
        known = starred.drop("b").join(signed.select(F.col("row").alias("node"), "bands"), "node")
        extra = _overlaps(_cross_pairs(known, spec, second.hot), second.sets)
        more = _confirmed(extra, spec)
        tables.append(extra)
        if more.limit(1).count():
            tables.append(labels)
            links.append(more)
            whole = links[0]
            for some in links[1:]:
                whole = whole.union(some)
            labels = components(whole)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    sizes = _often(named, "label")
    of = _dealt(named, lowest, sizes, "node", "label").select("h1", "h2", "label", "component_id")
    rows = signed.select("row", "doc_id", "text_hash", "h1", "h2", "n")
    # Rows without words are answered as they are; copies of one text are dealt to copies of its node's row.
    worded = rows.where("n > 0")
    copies = _often(worded, "h1", "h2")
    out = _dealt(worded, of, copies, "row", "h1", "h2").select("row", "doc_id", "text_hash", "n", F.col("label").alias("component"), "component_id")
    result = staged(out.unionByName(rows.where("n = 0").select("row", "doc_id", "text_hash", "n", F.col("row").alias("component"), F.col("doc_id").alias("component_id"))), "dedup-result")
    dropped(signed, nodes, sizes, copies, *tables, labels)
    return result


def near_duplicates(df: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over similar pairs) and kept of every row.

    Candidates share a band of minima (a pair at the threshold is missed with a chance below 1e-7), are cut down by the
    collision-corrected b-bit estimate and by exact bounds, and are confirmed on their full sets of 64-bit shingle
    hashes. Equal sets count as one. A bucket's members are first compared with one of them, then only those still
    apart with each other, in blocks. Rows without words (null or empty text) have no shingles and a component of their
    own; null doc_ids count as larger than any other, and a component of such rows alone has a null component_id and
    keeps all of them; repeated rows share a component and are kept together if theirs
    is the least id; an empty table gives no rows; other columns are not read.
    """
    out = _labelled(df, spec, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicated(df: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all columns, without near-duplicates: of each component the row of the least doc_id stays.

    Among rows of equal doc_id and text one stays. Rows without words stay, as they are like no other. The list of
    dropped rows is broadcast while it is small, else joined by shuffle.
    """
    out = _labelled(df, spec, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    best = out.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("key"), F.col("text_hash"))).alias("best"))
    lost = out.where("n > 0").join(best, "component").where((F.col("key") != F.col("best.key")) | (F.col("text_hash") != F.col("best.text_hash"))).select("key", "text_hash").distinct()
    lost = staged(lost, "dedup-lost", counting=F.lit(True))
    # The row travels as one struct, so that its columns can't clash with the keys.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    named = df.select(whole, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    kept = named.join(_small(lost), ["key", "text_hash"], "left_anti")
    again = out.where("n > 0").groupBy("key", "text_hash").count().where("count > 1").join(lost, ["key", "text_hash"], "left_anti").limit(1).count()
    if again:  # a kept row stands there more than once: these alone make a shuffle of texts needed
        same = Window.partitionBy("key", "text_hash").orderBy(F.lit(0))
        worded = out.where("n > 0").groupBy("key", "text_hash").count().where("count > 1").select("key", "text_hash", F.lit(True).alias("again"))
        marked = kept.join(worded, ["key", "text_hash"], "left")
        first = marked.where("again").withColumn("at", F.row_number().over(same)).where("at = 1").select("whole")
        kept = marked.where("again IS NULL").select("whole").unionByName(first)
    return kept.select("whole.*")
