"""Vector arithmetic over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _matrices(rows: pa.Array) -> list[np.ndarray | None]:
    """Each row's vectors as a matrix, cut from the flat values; None for a row without any."""
    inner = rows.values
    numbers = inner.values.to_numpy(zero_copy_only=False)
    starts, ends = rows.offsets.to_numpy(), inner.offsets.to_numpy()
    out: list[np.ndarray | None] = []
    for valid, a, b in zip(rows.is_valid().to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
        flat = numbers[ends[a] : ends[b]] if valid and b > a else numbers[:0]
        out.append(flat.reshape(b - a, -1).astype(float) if len(flat) else None)
    return out


@F.arrow_udf(DoubleType())
def maxsim(query: pa.Array, document: pa.Array) -> pa.Array:
    """Mean over the query's vectors of the largest dot product with any of the document's; 0 if either has none."""
    pairs = zip(_matrices(query), _matrices(document))
    return pa.array([0.0 if q is None or d is None else float((q @ d.T).max(axis=1).mean()) for q, d in pairs], pa.float64())
