"""Vector columns as matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * component) as whole numbers; beyond 64 bits the nearest of them."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) for each width among the vectors of a column without nulls."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64, copy=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        if len(rows) == len(sizes):
            yield width, rows, flat.reshape(len(rows), width)
        else:
            yield width, rows, flat[(starts[rows, None] + np.arange(width))]


def largest(*parts) -> int:
    """Largest absolute value in arrays or lists of whole numbers, exactly."""
    return max([0, *(max(abs(int(np.max(p))), abs(int(np.min(p)))) for p in parts if np.size(p))])
