"""Data quality: missing values, outliers, range rules, row validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.functions import rules as R
from clinrisk.operators.ordered import exact_quantiles
from clinrisk.schema import CONTINUOUS, MAX_REQUEST_PATIENTS, REQUEST_RULES, TABLE_RULES, Rule


def missing_values(df: DataFrame) -> DataFrame:
    """``(column, n_missing)`` of the columns that have missing values, from one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns])
    return counts.select(F.inline(rows)).where("n_missing > 0")


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def outlier_bounds(df: DataFrame, columns: list[str], method: str, threshold: float) -> dict[str, tuple]:
    """``iqr``: column -> (low, high) fences. ``zscore``: column -> (mean, sample std)."""
    if method == "iqr":
        quartiles = exact_quantiles(df, columns, [0.25, 0.75])
        return {c: (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)) if q1 is not None else (None, None)
                for c, (q1, q3) in quartiles.items()}
    if method == "zscore":
        row = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
        return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}
    raise ValueError(f"Unknown outlier method: {method}")


def detect_outliers(
    df: DataFrame, columns: list[str] | None = None, method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Append ``<column>_outlier`` booleans; NULL values and absent columns are never outliers.

    The statistics are a handful of numbers from one or two aggregate passes; marking the rows is a projection.
    """
    columns = [c for c in CONTINUOUS if c in df.columns] if columns is None else columns
    present = [c for c in columns if c in df.columns]
    bounds = outlier_bounds(df, present, method, threshold)

    def mask(c: str) -> Column:
        if c not in present or None in bounds[c]:
            return F.lit(False)
        a, b = bounds[c]
        if method == "iqr":
            return F.coalesce((F.col(c) < a) | (F.col(c) > b), F.lit(False))
        if b == 0:
            return F.lit(False)
        return F.coalesce(F.abs((F.col(c) - F.lit(a)) / F.lit(b)) > threshold, F.lit(False))

    return df.withColumns({f"{c}_outlier": mask(c) for c in columns})


def any_outlier(columns: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(f"{c}_outlier")
    return out


def outlier_rows(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row ``(n_rows, n_outlier_rows)``."""
    columns = [c for c in CONTINUOUS if c in df.columns] if columns is None else columns
    marked = detect_outliers(df, columns, method, threshold)
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_outlier(columns)).alias("n_outlier_rows"))


def _rule_checks(df: DataFrame, rules: list[Rule]) -> list[tuple[str, str, str, Column]]:
    checks = []
    for rule in rules:
        if rule.column not in df.columns:
            continue
        value = F.col(rule.column)
        if rule.values is not None:
            checks.append((rule.column, "values", R.values_text(rule), R.not_allowed(value, rule)))
        if rule.min is not None:
            checks.append((rule.column, "min", str(rule.min), R.below(value, rule)))
        if rule.max is not None:
            checks.append((rule.column, "max", str(rule.max), R.above(value, rule)))
    return checks


def range_violations(df: DataFrame, rules: list[Rule] = TABLE_RULES) -> DataFrame:
    """``(column, rule, expected, n_violations)`` of the broken rules: all rules in one aggregate over one scan."""
    checks = _rule_checks(df, rules)
    counts = df.agg(*[F.count_if(broken).alias(f"c{i}") for i, (*_, broken) in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("rule"), F.lit(text).alias("expected"),
                 F.col(f"c{i}").alias("n_violations"))
        for i, (c, kind, text, _) in enumerate(checks)
    ])
    return counts.select(F.inline(rows)).where("n_violations > 0")


def bad_values(df: DataFrame, rules: list[Rule] = TABLE_RULES) -> DataFrame:
    """``(column, value, n)``: every distinct disallowed value, as rows (the list is unbounded, so it is never an array)."""
    bad = [
        F.when(broken, F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
        for c, kind, _, broken in _rule_checks(df, rules) if kind == "values"
    ]
    found = df.select(F.inline(F.array_compact(F.array(*bad))))
    return found.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def violation_messages(df: DataFrame, rules: list[Rule] = TABLE_RULES) -> DataFrame:
    """``(column, rule, message)`` texts of the broken rules."""
    text = (F.when(F.col("rule") == "min", "values below minimum ")
            .when(F.col("rule") == "max", "values above maximum ").otherwise("invalid values, expected "))
    return range_violations(df, rules).select(
        "column", "rule",
        F.concat("column", F.lit(": "), F.col("n_violations").cast("string"), F.lit(" "), text, "expected").alias("message"))


def validate_requests(df: DataFrame, rules: list[Rule] = REQUEST_RULES) -> DataFrame:
    """Append ``errors ARRAY<STRING>`` and ``accepted``; row-local."""
    checked = df.withColumn("errors", R.row_errors(F.col, rules))
    return checked.withColumn("accepted", F.size("errors") == 0)


def validate_batches(df: DataFrame, limit: int | None = MAX_REQUEST_PATIENTS) -> DataFrame:
    """Append ``n_patients`` and ``accepted``: 1..limit patients per request (``None``: no upper limit)."""
    n = F.coalesce(F.size("patients"), F.lit(0))
    ok = n >= 1 if limit is None else n.between(1, limit)
    return df.withColumns({"n_patients": n, "accepted": ok})
