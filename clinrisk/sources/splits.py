"""Split tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write partitioned by ``split``, so that reading one split reads only its files."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All splits, or one; a split that was never written gives no rows."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
