"""Vectors as whole numbers: the rows that take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def whole_numbers(vector: Column, scale: int, bound: Column) -> Column:
    """``floor(scale * x)`` of every component, as ``array<int>``; an error where one passes ``bound`` in size."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(whole, lambda x: (x >= -bound) & (x <= bound))
    return F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit("a vector's components are too large for exact sums in 64 bits")))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    """A list column whose lists are equally long, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def single_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, bound) -> DataFrame:
    """(``id``, ``size``, ``v``): one whole-number vector per id that has one; of several the smallest. ``bound`` maps the length to the largest size."""
    given = F.col(f"`{vector_col}`")
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & usable(given))
    whole = kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_numbers(given, scale, bound(F.size(given))).alias("v"))
    return whole.groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("size"), "v")
