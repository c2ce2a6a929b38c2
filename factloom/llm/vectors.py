"""Vectors as exact integers, for the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers below this add and multiply exactly in doubles, or in longs.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers; an empty one is."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry, as longs; what exceeds a long is the nearest one."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def matrix(column, width: int):
    """An Arrow list column of longs as a matrix; shorter rows are filled with zeros."""
    import numpy as np

    n = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), "i8")
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def largest(x) -> int:
    """The largest absolute value of an array of longs, as an int of any size."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def widest(df: DataFrame, column: str) -> int:
    """The length of a table's longest vector."""
    return df.agg(F.max(F.size(column))).first()[0] or 0
