"""Vectors as whole numbers, and matrices as Arrow columns: shared by vector codes and centroid clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.text import let

#: Relative slack that covers the rounding of roots and norms in double precision.
SLACK = 1e-11


def all_finite(vector: str) -> Column:
    """Whether a vector is there and has no null and no non-finite component."""
    x = F.col(vector)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def largest(components: Column) -> Column:
    """The bound of a whole component: squared distances of vectors of so many components stay within 64 bits."""
    return F.pow(F.lit(2.0), F.floor((F.lit(60) - F.ceil(F.log2(F.greatest(components, F.lit(1))))) / 2))


def floors(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision; components beyond the bound count as the bound."""
    return let(largest(F.size(vector)), lambda most: F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most)).cast("int")))


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a column of lists of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    """A column of lists from a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel()))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, in whole numbers."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def displacement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the last axis of a and b, rounded up."""
    return np.sqrt(((a - b).astype(float) ** 2).sum(-1)) * (1 + SLACK)
