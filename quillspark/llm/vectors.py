"""Reading vector columns: which rows count, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, v), dimension): rows with an id and a finite vector that is not zero and has the most common length (the least such length in a tie).

    Of rows that repeat an id, the one of least vector counts. An id that is no whole number counts as null.
    """
    rows = df.select(whole(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows, 0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where((F.size("v") == sizes[0]) & fine).groupBy("vec_id").agg(F.min("v").alias("v")), sizes[0]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    wide = m.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True, initial=1e-300)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)
