"""What the searches over vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a finite vector, as doubles; rows that repeat another wholly count once."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")))
    return rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists as rows; shorter ones are filled up with zeros, which changes no inner product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.diff(lists.offsets.to_numpy())
    most = max(width or 0, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == most).all():
        return flat.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
