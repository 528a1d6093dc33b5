"""Rows with vectors: which take part, and numpy forms of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(name: str = "embedding") -> Column:
    """True for vectors all of whose components are finite numbers, the vector without components among them."""
    v = F.col(name)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def usable(name: str = "embedding") -> Column:
    """True for vectors with finite components of which one at least isn't zero."""
    v = F.col(name)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """n x dim doubles of a list column whose lists have dim values each."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / norms(x)[:, None]
