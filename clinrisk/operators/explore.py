"""Exploration and preparation beyond the model space: imputation, ordinal codes, histograms, tests against the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.operators.ordered import exact_quantiles
from clinrisk.operators.prep import Category, fit_categories

STRATEGIES = ("mean", "median")


def fit_fill(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> dict[str, float]:
    """The value that takes the place of NULL per column; a column without any value raises ``ValueError``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    if strategy == "median":
        found = {c: q[0] for c, q in exact_quantiles(df, list(columns), [0.5]).items()}
    else:
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        found = {c: row[c] for c in columns}
    if empty := [c for c, v in found.items() if v is None]:
        raise ValueError(f"No values in columns: {empty}")
    return {c: float(v) for c, v in found.items()}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """``df`` with NULLs of the fitted columns replaced; these become doubles. A projection."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})


def ordinal_encode(df: DataFrame, categories: dict[str, list[Category]]) -> DataFrame:
    """Append ``<column>_code``: the place of the category in its list, from 0; NULL for NULL and for unseen categories.

    The lists may be written down in their own order or come from ``fit_categories`` (sorted).
    """
    out = {}
    for c, levels in categories.items():
        code = F.lit(None).cast("int")
        for i, level in reversed(list(enumerate(x for x in levels if x is not None))):
            code = F.when(F.col(c) == F.lit(level), F.lit(i)).otherwise(code)
        out[f"{c}_code"] = code
    return df.withColumns(out)


def fit_ordinal(df: DataFrame, columns: Sequence[str]) -> dict[str, list[Category]]:
    return fit_categories(df, list(columns))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, lower, upper, n)`` of equally wide bins between the least and greatest value; the last one is closed.

    All bins are returned, empty ones too; NULLs are not counted. A column of one value has one bin; one without values none.
    """
    value = F.col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    bins = bins if high > low else 1
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def label_tests(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Per numeric column: correlation with the 0/1 label, and Welch's t statistic and degrees of freedom between the classes.

    One aggregate for all columns, over rows where column and label are present. NULL where a class is too small or constant.
    """
    aggs = []
    for i, c in enumerate(columns):
        for k in (0, 1):
            own = F.when(F.col(label) == k, F.col(c).cast("double"))
            aggs += [F.count(own).alias(f"n{k}_{i}"), F.avg(own).alias(f"m{k}_{i}"), F.var_samp(own).alias(f"v{k}_{i}")]
    sums = df.agg(*aggs)
    entries = []
    for i, c in enumerate(columns):
        n0, n1, m0, m1, v0, v1 = (F.col(f"{s}{k}_{i}") for s in "nmv" for k in (0, 1))
        n, p = n0 + n1, n1 / F.nullif(n0 + n1, F.lit(0))
        within = F.coalesce(v0 * (n0 - 1), F.lit(0.0)) + F.coalesce(v1 * (n1 - 1), F.lit(0.0))
        total = within + n0 * n1 * (m1 - m0) * (m1 - m0) / n
        r = (m1 - m0) * F.sqrt(p * (1 - p) * n / F.when(total > 0, total))
        a, b = v0 / n0, v1 / n1
        t = (m1 - m0) / F.sqrt(F.when(a + b > 0, a + b))
        freedom = (a + b) * (a + b) / F.when(a + b > 0, a * a / (n0 - 1) + b * b / (n1 - 1))
        usable = (n0 > 1) & (n1 > 1)
        entries.append(F.struct(F.lit(c).alias("column"), F.when((n0 > 0) & (n1 > 0), r).alias("r"), F.when(usable, t).alias("t"),
                                F.when(usable, freedom).alias("freedom")))
    return sums.select(F.inline(F.array(*entries)))


def chi_square(df: DataFrame, column: str, label: str) -> DataFrame:
    """``(n, statistic, freedom, cramers_v)`` of two categorical columns, from their table of counts; rows with a NULL are left out."""
    counts = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(column).alias("a"), F.col(label).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    rows, columns = (counts.groupBy(k).agg(F.sum("n").alias(f"n_{k}")) for k in "ab")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0.0
    # Empty cells count their expectation; all expectations add up to the total.
    cells = counts.join(rows, "a").join(columns, "b").withColumn("e", F.col("n_a") * F.col("n_b") / F.lit(total or 1.0))
    found = cells.agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e") - F.col("e")).alias("s"),
                      F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    statistic = F.coalesce(F.col("s") + F.lit(total), F.lit(0.0))
    least = F.least(F.col("r"), F.col("c")) - 1
    return found.select(
        F.lit(int(total)).cast("bigint").alias("n"), statistic.alias("statistic"),
        (F.greatest(F.col("r") - 1, F.lit(0)) * F.greatest(F.col("c") - 1, F.lit(0))).cast("bigint").alias("freedom"),
        F.when((least > 0) & F.lit(total > 0), F.sqrt(statistic / F.lit(total or 1.0) / least)).alias("cramers_v"))
