"""Exact, deterministic stratified splits and folds.

Part sizes and per-class quotas come from class counts; which rows fill a quota is decided by the hashed order of a unique
key. The result is the input plus one column computed row by row: no shuffle of the table, any number of partitions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.operators.ordered import assign_by_cuts, class_counts, rank_cuts

SPLITS = ["train", "val", "test"]


def largest_remainder(counts: Mapping, draws: int) -> dict:
    """Integer shares of ``draws`` proportional to the counts; ties go to the smaller label."""
    total = sum(counts.values())
    exact = {c: n / total * draws for c, n in counts.items()}
    share = {c: math.floor(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: share[c] - exact[c])
    for c in order[: draws - sum(share.values())]:
        share[c] += 1
    return share


def split_sizes(n: int, val_ratio: float, test_ratio: float) -> tuple[int, int, int]:
    held_out = math.ceil(n * (val_ratio + test_ratio))
    test = math.ceil(held_out * (1 - val_ratio / (val_ratio + test_ratio)))
    return n - held_out, held_out - test, test


def split_quotas(counts: Mapping, train_ratio: float, val_ratio: float, test_ratio: float) -> dict:
    """Class -> (train, val, test) row counts."""
    total = train_ratio + val_ratio + test_ratio
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"Ratios must sum to 1.0, got {total}")
    sizes = split_sizes(sum(counts.values()), val_ratio, test_ratio)
    small = [c for c, n in counts.items() if n < 2]
    if small:
        raise ValueError(f"Classes with fewer than 2 rows: {small}")
    if min(sizes) < len(counts):
        raise ValueError(f"A part of {min(sizes)} rows cannot hold {len(counts)} classes")
    train = largest_remainder(counts, sizes[0])
    rest = {c: counts[c] - train[c] for c in counts}
    val = largest_remainder(rest, sizes[1])
    return {c: (train[c], val[c], rest[c] - val[c]) for c in counts}


def stratified_split(
    df: DataFrame, key: str, label: str = "target", train_ratio: float = 0.70, val_ratio: float = 0.15,
    test_ratio: float = 0.15, seed: int = 42,
) -> DataFrame:
    """Append ``split`` in train / val / test."""
    if abs(train_ratio + val_ratio + test_ratio - 1.0) > 1e-6:
        raise ValueError(f"Ratios must sum to 1.0, got {train_ratio + val_ratio + test_ratio}")
    quotas = split_quotas(class_counts(df, label), train_ratio, val_ratio, test_ratio)
    ranks = {c: [train, train + val] for c, (train, val, _) in quotas.items()}
    cuts = rank_cuts(df, key, label, seed, ranks)
    return assign_by_cuts(df, "split", key, label, seed, cuts, SPLITS)


def split_balance(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows and positive share per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("positive_share"))


def fold_quotas(counts: Mapping, k: int) -> dict:
    """Class -> rows per fold, as if the label-sorted rows were dealt to the folds in turn."""
    out, offset = {}, 0
    for c, n in counts.items():
        out[c] = [len(range((i - offset) % k, n, k)) for i in range(k)]
        offset += n
    return out


def stratified_folds(df: DataFrame, key: str, label: str = "target", k: int = 5, seed: int = 42) -> DataFrame:
    """Append ``fold`` in 0..k-1, class shares equal in all folds."""
    counts = class_counts(df, label)
    if k < 2 or all(n < k for n in counts.values()):
        raise ValueError(f"Cannot make {k} folds of classes with {counts} rows")
    ranks = {}
    for c, sizes in fold_quotas(counts, k).items():
        ranks[c] = [sum(sizes[: i + 1]) for i in range(k - 1)]
    cuts = rank_cuts(df, key, label, seed, ranks)
    return assign_by_cuts(df, "fold", key, label, seed, cuts, list(range(k)))
