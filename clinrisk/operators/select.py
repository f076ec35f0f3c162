"""Feature selection: correlation, variance, recursive elimination, importance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinrisk.operators.newton import TASKS_PER_CORE
from clinrisk.operators.train import LinearModel, LogisticSpec, fit_task, fitting_data, matrix_counts, solve_many
from clinrisk.operators.trees import TreeModel, node_importances

CORRELATION_SCHEMA = "a string, b string, r double"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson r of every pair (a before b) over the rows where both are present; None if either is constant there.

    A first pass finds means and spreads, by which the columns are centred and scaled. A second one sums, for all pairs at
    once and whatever the number of columns and NULLs, counts, values, squares and products over the rows where both are
    present: four matrix products per batch, one block per task, and one sum of the blocks.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    stats = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    out: dict[tuple[str, str], float | None] = dict.fromkeys(combinations(columns, 2))
    varying = [c for c in columns if stats[f"s_{c}"]]
    if len(varying) < 2:
        return out
    n, x, xx, xy = _pair_sums(df.select(*[
        ((F.col(c).cast("double") - F.lit(float(stats[f"m_{c}"]))) / F.lit(float(stats[f"s_{c}"]))).alias(f"x{i}") for i, c in enumerate(varying)]),
        len(varying))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = xx - x * x / n
        r = (xy - x * x.T / n) / np.sqrt(spread * spread.T)
    for i, a in enumerate(varying):
        for j in range(i + 1, len(varying)):
            # Within rounding of the sums a column is constant on the common rows.
            if min(spread[i, j], spread[j, i]) > 1e-12 * max(n[i, j], 1.0):
                out[a, varying[j]] = float(np.clip(r[i, j], -1.0, 1.0))
    return out


def _pair_sums(rows: DataFrame, d: int) -> np.ndarray:
    """Four d x d matrices over the rows where both i and j are present: rows, sums of i, sums of squares of i, products."""
    def partial(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            total += [known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["block"])

    def add(batches):
        total, found = np.zeros((4, d, d)), False
        for batch in batches:
            for block in batch.column(0).to_pylist():
                total, found = total + np.frombuffer(block).reshape(4, d, d), True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["block"])

    tasks = max(1, TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    blocks = rows.coalesce(tasks).mapInArrow(partial, "block binary").repartition(max(1, int(tasks**0.5))).mapInArrow(add, "block binary").collect()
    return np.sum([np.frombuffer(b["block"]).reshape(4, d, d) for b in blocks], axis=0)


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Upper triangle as rows ``(a, b, r)``."""
    rows = [(a, b, r) for (a, b), r in correlations(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, CORRELATION_SCHEMA)


def correlated_features(df: DataFrame, threshold: float = 0.9, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose |r| with an earlier column is above the threshold."""
    columns = numeric_columns(df) if columns is None else list(columns)
    high = {b for (_, b), r in correlations(df, columns).items() if r is not None and abs(r) > threshold}
    return [c for c in columns if c in high]


def select_by_variance(df: DataFrame, threshold: float = 0.01, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with population variance above the threshold; ``ValueError`` if none."""
    columns = numeric_columns(df) if columns is None else list(columns)
    row = df.agg(*[a for c in columns for a in (
        F.var_pop(c).alias(f"v_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()

    def keeps(c: str) -> bool:
        v = row[f"v_{c}"]
        return v is not None and v > threshold and (threshold > 0 or row[f"lo_{c}"] != row[f"hi_{c}"])

    kept = [c for c in columns if keeps(c)]
    if not kept:
        raise ValueError(f"No feature meets the variance threshold {threshold}")
    return kept


def select_by_rfe(df: DataFrame, features: Sequence[str], label: str, spec: LogisticSpec, n_features: int = 10,
                  step: int = 1, method: str = "newton") -> tuple[list[str], list[tuple[str, int]]]:
    """Drop the ``step`` features of smallest squared coefficient until ``n_features`` are left.

    Returns the kept features and, for every feature, its rank (1 = kept, higher = dropped earlier). One matrix is cached;
    a refit holds the dropped coefficients at 0 and starts from the previous solution, so it takes only a few passes.
    """
    matrix = fitting_data(df, features, label, method)
    free, rounds, beta = np.ones(len(features) + 1, bool), [], None
    try:
        c = matrix_counts(matrix)[0]
        while free[:-1].sum() > n_features:
            task = (c["n"], c["pos"], spec, fit_task(c["n"], c["pos"], spec, free=free, start=beta))
            (beta,), _ = solve_many(matrix, features, [task], method=method)
            left = np.flatnonzero(free[:-1])
            drop = left[np.argsort(beta[left] ** 2, kind="stable")][: min(step, len(left) - n_features)]
            rounds.append([features[i] for i in sorted(drop)])
            free = free.copy()
            free[drop] = False
    finally:
        matrix.unpersist()
    kept = [f for f, is_free in zip(features, free) if is_free]
    ranks = {f: 1 for f in kept}
    for distance, dropped in enumerate(reversed(rounds)):
        ranks.update({f: distance + 2 for f in dropped})
    return kept, [(f, ranks[f]) for f in features]


def importances(df_or_spark, model: LinearModel | TreeModel) -> DataFrame:
    """``(feature, importance)``, largest first, ties by name: |coefficient|, or the share of the gain of a tree model's splits."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    if isinstance(model, TreeModel):
        return node_importances(model.to_table(spark))
    rows = [(f, abs(b)) for f, b in zip(model.features, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def select_by_importance(model: LinearModel | TreeModel, threshold: float = 0.01) -> list[str]:
    """Features whose share of the summed |coefficient|, or of the gain, is above the threshold."""
    if isinstance(model, TreeModel):
        share = {r["feature"]: r["importance"] for r in importances(SparkSession.active(), model).collect()}
        return [f for f in model.features if share[f] > threshold]
    coefficients = getattr(model, "coefficients", None)
    if coefficients is None:
        raise ValueError("Model has no coefficients to rank features by")
    total = sum(map(abs, coefficients))
    return [f for f, b in zip(model.features, coefficients) if total > 0 and abs(b) / total > threshold]
