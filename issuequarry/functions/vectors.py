"""Vector expressions, plus the array helpers used inside Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(F.aggregate(F.zip_with(a, b, squared), F.lit(0.0), lambda acc, x: acc + x))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(a, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(a)


def stack(column) -> np.ndarray:
    """Rows of an Arrow list column as one float64 matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def pairwise_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))
