"""Row-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Append (or, with ``keep``, select) columns whose expressions run once per row.

    The optimizer substitutes projected expressions into later filters and branches, so a hash or a JSON parse would run
    once per use. A generator of exactly one row is not seen through.
    """
    kept = ["*"] if keep is None else keep
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
