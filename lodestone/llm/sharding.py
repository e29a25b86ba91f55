"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, staged


def with_hilbert_place(df: DataFrame, cells: Sequence[str], bits: int, name: str = "place") -> DataFrame:
    """`df` with the place on the Hilbert curve of the columns `cells` (below 2**bits each), which are used up.

    The same curve as `hilbert_index`, in bit expressions: one fold over levels and axes, then Gray code and digits.
    """
    rest, n = [c for c in df.columns if c not in cells], len(cells)
    # Step k works on axis k % n and the bit q of its level: it inverts the first axis' lower bits or swaps them.
    axis, q = f"x[k % {n}]", f"shiftleft(1L, {bits - 1} - k div {n})"
    low, flip = f"({q} - 1)", f"{axis} & {q} <> 0"
    swap = f"((x[0] ^ {axis}) & {low})"
    moved = f"transform(x, (v, j) -> CASE WHEN j = 0 THEN v ^ IF({flip}, {low}, {swap}) WHEN j = k % {n} AND NOT {flip} THEN v ^ {swap} ELSE v END)"
    turned = f"aggregate(sequence(0, {n * (bits - 1) - 1}), _x, (x, k) -> {moved})" if bits > 1 else "_x"
    df = df.select(*rest, F.array(*[F.col(c).cast("long") for c in cells]).alias("_x")).select(*rest, F.expr(turned).alias("_x"))
    df = df.select(*rest, *[F.expr(" ^ ".join(f"_x[{j}]" for j in range(i + 1))).alias(f"_y{i}") for i in range(n)])
    gray = " ^ ".join([f"IF(_y{n - 1} & {1 << level} <> 0, {(1 << level) - 1}L, 0L)" for level in range(bits - 1, 0, -1)] or ["0L"])
    df = df.select(*rest, F.array(*[F.col(f"_y{i}") for i in range(n)]).alias("_y"), F.expr(gray).alias("_gray"))
    digits = [f"shiftleft(shiftright(_y[{i}] ^ _gray, {level}) & 1L, {level * n + n - 1 - i})" for level in range(bits) for i in range(n)]
    return df.select(*rest, F.expr(" | ".join(digits)).alias(name))


def hilbert_index(axes: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points whose coordinates lie below 2**bits (Skilling's transform), for readers that
    want to know which part of the curve a point lies on."""
    x = [np.asarray(a, dtype=np.uint64).copy() for a in axes]
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        gray = np.where((x[n - 1] & q) != 0, gray ^ (q - one), gray)
    x = [a ^ gray for a in x]
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            place = (place << one) | ((a >> np.uint64(level)) & one)
    return place


def _number(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(lowest, highest) of a dimension, to find what all strings start with."""
    return F.min(name).alias(f"lo_{name}"), F.max(name).alias(f"hi_{name}")


def _code(kind: T.DataType, name: str, lo: object, hi: object) -> Column:
    """A number that rises with the values: of strings, six bytes after the prefix that all values share."""
    if not isinstance(kind, T.StringType):
        return F.col(name).cast("double")
    a, b = (str(v or "").encode("utf-8") for v in (lo, hi))
    shared = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return F.expr(f"CAST(conv(rpad(hex(substr(CAST({name} AS binary), {shared + 1}, 6)), 12, '0'), 16, 10) AS double)")


def _cell(name: str, edges: list[float]) -> str:
    """SQL of how many of the rising edges lie below the column's value: a decision tree, so a cell takes a few tests."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        middle = (lo + hi) // 2
        return f"IF({name} <= {float(edges[middle])!r}D, {tree(lo, middle)}, {tree(middle + 1, hi)})"

    return f"IF({name} IS NULL, 0, {tree(0, len(edges))})"


def hilbert_shards(df: DataFrame, dimensions: dict[str, Column], shards: int = 24, bits: int = 7, id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, place (on the curve), shard, slot, and the carried columns of every row.

    Each dimension (a number, date or string) is quantised at up to 2**bits - 1 quantiles of all its values, found by
    mergeable sketches of bounded size (their last digits may depend on the order of merging, so cells' edges may differ a
    little between two runs on many tasks; one run uses one set of edges throughout); nulls get the first cell, NaN the
    last. Rows are sorted by the curve's place, then doc_id, and
    cut at equal counts, so shards' counts differ by one at most and each shard covers a compact box of the
    dimensions. Only the key, the dimensions and `carry` are sorted. Ranks come from counts of the sorted partitions
    (one number each). Equal rows may take each other's places. Null doc_ids come first in their cell; an empty table
    gives no rows; columns that are not named are not read, whatever their names. All of it is SQL expressions.
    """
    names = [f"d{i}" for i in range(len(dimensions))]
    kept = {f"c{i}": c for i, c in enumerate((carry or {}).values())}
    base = staged(df.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in zip(names, dimensions.values())], *[c.alias(n) for n, c in kept.items()]), "sharding-rows")
    kinds = {f.name: f.dataType for f in base.schema.fields}
    ends = base.agg(*[c for n in names for c in _number(base, n)]).first()
    coded = base.select("doc_id", *kept, *[_code(kinds[n], n, ends[f"lo_{n}"], ends[f"hi_{n}"]).alias(n) for n in names])
    steps = [i / 2**bits for i in range(1, 2**bits)]
    cuts = coded.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()
    celled = coded.select("doc_id", *kept, *[F.expr(_cell(n, sorted(set(cuts[n] or [])))).cast("long").alias(n) for n in names])
    curve = with_hilbert_place(celled, names, bits)
    ordered = curve.repartitionByRange("place", "doc_id", *kept).sortWithinPartitions("place", "doc_id", *kept)
    local = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    cut = staged(local, "sharding-order")
    dropped(base)
    first, n = {}, 0
    for part, count in sorted(map(tuple, cut.groupBy("part").count().collect())):  # as many numbers as sorted partitions
        first[part], n = n, n + count
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(first.items()), "part int, first long")
    ranked = cut.join(F.broadcast(offsets), "part").withColumn("rank", F.col("first") + F.col("at"))
    shard = F.expr(f"rank * {shards} div {max(n, 1)}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id", "place", "shard", F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}").cast("long").alias("slot"), *[F.col(k).alias(name) for k, name in zip(kept, carry or {})]
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its files runs of the curve in slot order, so that readers prune files by the minima and
    maxima of their columns. Ranges of slots are dealt out, so no task has to hold a shard."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
