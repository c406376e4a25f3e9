"""Rows of integer vectors: the usable rows of a table of float vectors, as numpy matrices in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256  # a component x becomes floor(SCALE * x)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """(vec_id, vector, the named columns) of the rows whose vector has neither null nor non-finite components."""
    x = F.col(vector_col)
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("vector"),
                                   *(c.alias(k) for k, c in more.items()))


def measured(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, longest vector, largest magnitude of an integer component).

    Sums over a vector's products and squares must fit in 64 bits; larger
    components raise an error instead of giving wrong sums.
    """
    n, width, most = rows.agg(F.count("*"), F.max(F.size("vector")),
                              F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))))).first()
    width, bound = width or 0, int(SCALE * (most or 0.0)) + 1
    if 4 * width * bound * bound >= 1 << 63:
        raise ValueError(f"components up to {most} in {width} dimensions: exact sums need more than 64 bits")
    return n, width, bound


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list column as (rows, width) integers; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def slices(n: int, step: int) -> Iterator[slice]:
    return (slice(i, min(n, i + step)) for i in range(0, n, step))
