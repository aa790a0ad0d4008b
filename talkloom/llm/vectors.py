"""Embedding columns as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def sound(vector: str) -> Column:
    """Whether the vector is there, not empty and holds finite numbers only."""
    v = F.col(f"`{vector}`")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: good(x.cast("double"))), F.lit(False))


def sound_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array of double) and dim, without the vectors that can't be compared."""
    rows = df.where(sound(vector_col))
    vector = F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    return rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector, F.size(f"`{vector_col}`").alias("dim"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
