"""Vectors in array columns: which take part, and how a task reads them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column = "embedding") -> Column:
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` of the rows that take part, and their dimension.

    The dimension is that of most usable rows (ties: the smaller); rows of another one, and rows
    with a null id, take no part.
    """
    rows = df.select("vec_id", "embedding").where(usable() & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    dimension = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("embedding") == dimension), dimension


def matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimension)
