"""The Hilbert places of the sharding operator against the plain transform and plain quantile cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import sharding


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 5), (3, 7), (4, 2), (2, 1)])
def test_places_of_expressions(spark, n, bits):
    points = np.random.default_rng(n).integers(0, 2**bits, (300, n))
    names = [f"x{k}" for k in range(n)]
    df = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(points)], "id long, " + ", ".join(f"{c} long" for c in names))
    got = dict(map(tuple, sharding.with_hilbert_place(df, names, bits).collect()))
    assert [got[i] for i in range(len(points))] == sharding.hilbert_index(list(points.T), bits).tolist()


def test_cells_of_a_table(spark):
    """Places, shards and slots of a table whose quantiles are plain: cells hold equal shares of the values."""
    rng = np.random.default_rng(4)
    names = ["ash", "birch", "elm", "oak"]
    rows = [(i, names[int(rng.integers(4))], int(v)) for i, v in enumerate(rng.permutation(640))]
    df = spark.createDataFrame(rows, "doc_id long, tree string, size long").repartition(3)
    got = {r.doc_id: r for r in sharding.hilbert_shards(df, {"tree": F.col("tree"), "size": F.col("size")}, shards=7, bits=4).collect()}
    ordered = sorted(r[1] for r in rows)
    tree_edges = sorted({ordered[-(-640 * k // 16) - 1] for k in range(1, 16)})
    size_edges = [-(-640 * k // 16) - 1 for k in range(1, 16)]
    cells = [np.array([sum(e < r[1] for e in tree_edges) for r in rows]), np.array([sum(e < r[2] for e in size_edges) for r in rows])]
    places = sharding.hilbert_index(cells, 4)
    assert [got[r[0]].place for r in rows] == places.tolist()
    order = sorted(range(640), key=lambda i: (places[i], i))
    for rank, i in enumerate(order):
        shard = rank * 7 // 640
        assert got[i].shard == shard and got[i].slot == rank - -(-shard * 640 // 7)


def test_no_python_in_the_plan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, None, 1.0), (3, "b", None)], "doc_id long, t string, v double")
    out = sharding.hilbert_shards(df, {"t": F.col("t"), "v": F.col("v")}, shards=2, bits=3)
    assert "Arrow" not in out._jdf.queryExecution().toString() and out.count() == 3
