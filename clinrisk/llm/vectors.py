"""What the operators on embedding tables share: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vector: str | Column) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~odd, F.lit(False))


def dimensions(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, of equals the largest; 0 without vectors. Only one count per length is collected."""
    counts = df.groupBy(F.size(vector).alias("size")).count().where("size > 0")
    row = counts.agg(F.max(F.struct("count", "size"))["size"]).first()
    return int(row[0] or 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of lists, none NULL and each of ``d`` entries, as rows x d."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
