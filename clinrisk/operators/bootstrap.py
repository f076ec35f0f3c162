"""Bootstrap confidence intervals of metrics: Poisson weights from hashes, one shuffle for all replicates.

A replicate counts a row as often as a Poisson(1) number says, which depends on the row's key and the replicate's number only.
So weights are never stored or joined: tasks work them out where rows are. Rows are dealt to score buckets once, and tasks
walk through a bucket from high to low scores and hold one running sum for each replicate. What is left is a row of
sums for each bucket and replicate, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.operators.metrics import _metric_columns
from clinrisk.operators.ordered import bucketed, quantile_splits

# Hashes are taken modulo this prime; products of two of them fit a long.
PRIME = 2**31 - 1
# Weights of so many rows and replicates are in memory at once.
CELLS = 1 << 20
# Parts that rows of one frequent score are dealt to.
SALTS = 32
METRICS = ["roc_auc", "accuracy", "precision", "recall", "f1", "specificity", "npv"]


def poisson_limits() -> list[int]:
    """A number below PRIME has as many of these at or below it as its Poisson(1) weight says."""
    out, share = [], 0.0
    for k in range(12):
        share += math.exp(-1) / math.factorial(k)
        out.append(int(share * PRIME))
    return out


def _hash(text: Column, at: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 10).cast("long"), F.lit(PRIME))


def _draws(df: DataFrame, replicates: int, seed: int) -> tuple[np.ndarray, ...]:
    """Three random numbers of each replicate."""
    number = F.col("id").cast("string")
    rows = df.sparkSession.range(1, replicates + 1).orderBy("id").select(*[_hash(F.concat(F.lit(f"{seed}-{c}-"), number), 1).alias(c) for c in "abc"]).collect()
    return tuple(np.array([r[c] for r in rows], np.int64) for c in "abc")


def _walk(batches: Iterator[pa.RecordBatch], draws: tuple[np.ndarray, ...], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sums of each (part, point) in rows sorted by part, point and falling score; equal scores may lie in several batches."""
    limits, replicates = np.array(poisson_limits()), len(draws[0])
    step = max(1, CELLS // replicates)
    group, state = None, None

    def weights(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b, c = draws
        return np.searchsorted(limits, (h1[:, None] * a % PRIME + h2[:, None] * b % PRIME + c) % PRIME, "right")

    def out(group, s) -> pa.RecordBatch:
        finish(s)
        arrays = [pa.array([s[k].tolist()], pa.list_(pa.int64())) for k in ("pos", "neg", "pairs", "tp", "fp")]
        return pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.bool_()), *arrays], ["part", "point", "pos", "neg", "pairs", "tp", "fp"])

    def finish(s) -> None:
        s["pairs"] += s["tie_neg"] * (2 * s["pos"] + s["tie_pos"])
        s["pos"] += s["tie_pos"]
        s["neg"] += s["tie_neg"]
        s["tie_pos"], s["tie_neg"] = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)

    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part, point, score, positive, h1, h2 = (c.to_numpy(zero_copy_only=False) for c in batch.slice(low, step).columns)
            w = weights(h1, h2)
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (point[1:] != point[:-1]) | (score[1:] != score[:-1])
            first = np.flatnonzero(new)
            pos, neg = (np.add.reduceat(w * m[:, None], first, axis=0) for m in (positive, ~positive))
            for i, at in enumerate(first):
                here = (int(part[at]), bool(point[at]))
                if here != group:
                    if group is not None:
                        yield out(group, state)
                    group, state = here, {k: np.zeros(replicates, np.int64) for k in ("pos", "neg", "pairs", "tp", "fp", "tie_pos", "tie_neg")} | {"score": score[at]}
                if score[at] != state["score"]:
                    finish(state)
                    state["score"] = score[at]
                state["tie_pos"] += pos[i]
                state["tie_neg"] += neg[i]
                if score[at] >= threshold:
                    state["tp"] += pos[i]
                    state["fp"] += neg[i]
    if group is not None:
        yield out(group, state)


def bootstrap_replicates(df: DataFrame, score: str, label: str, key: str, replicates: int = 200, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """``(replicate, roc_auc, accuracy, precision, recall, f1, specificity, npv)`` of each replicate, from 1.

    Rows without score (NULL or NaN) or label are left out; rows of one key are drawn together, as are all rows without a key. The area is NULL where a replicate
    lacks a class; the other metrics are 0 on a zero denominator. Without rows there are no replicates.
    """
    keyed = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()).select(
        F.col(score).cast("double").alias("score"), (F.col(label) == 1).alias("positive"), _hash(keyed, 1).alias("h1"), _hash(keyed, 9).alias("h2"))
    edges = quantile_splits(rows, "score")
    marked = bucketed(rows, "score", edges, "part")
    # A score that many rows have is an edge, the lowest of its bucket. Its rows all tie, so they need not meet.
    lower = df.sparkSession.createDataFrame([(i + 1, e) for i, e in enumerate(edges)], "part int, edge double")
    marked = marked.join(F.broadcast(lower), "part", "left")  # as many rows as there are edges
    marked = marked.withColumn("point", F.coalesce(F.col("score") == F.col("edge"), F.lit(False)))
    salt = F.when(F.col("point"), F.pmod("h1", F.lit(SALTS))).otherwise(0)
    placed = marked.withColumn("salt", salt).repartition("part", "point", "salt").sortWithinPartitions("part", "point", F.desc("score"))
    draws = _draws(df, replicates, seed)

    def run(batches):
        yield from _walk(batches, draws, threshold)

    lists = ", ".join(f"{c} array<long>" for c in ("pos", "neg", "pairs", "tp", "fp"))
    sums = placed.select("part", "point", "score", "positive", "h1", "h2").mapInArrow(run, f"part int, point boolean, {lists}")
    each = sums.select("part", "point", F.posexplode(F.arrays_zip("pos", "neg", "pairs", "tp", "fp")).alias("replicate", "s"))
    parts = each.groupBy("replicate", "part", "point").agg(*[F.sum(f"s.{c}").cast("double").alias(c) for c in ("pos", "neg", "pairs", "tp", "fp")])
    above = Window.partitionBy("replicate").orderBy(F.desc("part"), "point").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.when(F.col("point"), F.col("pos") * F.col("neg")).otherwise(F.col("pairs"))
    ordered = parts.withColumn("twice", pairs + 2 * F.col("neg") * F.coalesce(F.sum("pos").over(above), F.lit(0.0)))
    total = ordered.groupBy("replicate").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.sum("pos") - F.sum("tp")).alias("fn"),
                                             (F.sum("neg") - F.sum("fp")).alias("tn"), F.try_divide(F.sum("twice"), 2 * F.sum("pos") * F.sum("neg")).alias("roc_auc"))
    m = _metric_columns()
    return total.select((F.col("replicate") + 1).cast("long").alias("replicate"), "roc_auc", *[m[c].alias(c) for c in METRICS[1:]])


def bootstrap_intervals(df: DataFrame, score: str, label: str, key: str, replicates: int = 200, level: float = 0.95, threshold: float = 0.5,
                        seed: int = 42, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``(metric, replicates, mean, std_error, lower, upper)``: percentile intervals over the replicates that have the metric.

    Bounds are interpolated linearly. A metric that no replicate has gives NULL bounds; without rows every metric does.
    """
    unknown = sorted(set(metrics) - set(METRICS))
    if unknown or not 0 < level < 1 or replicates < 2:
        raise ValueError(f"Unknown metrics {unknown}, or a level outside (0, 1), or fewer than two replicates")
    table = bootstrap_replicates(df, score, label, key, replicates, threshold, seed)
    tail = (1 - level) / 2
    row = table.agg(*[F.struct(F.count(c).alias("replicates"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std_error"), F.percentile(c, F.lit(tail)).alias("lower"),
                               F.percentile(c, F.lit(1 - tail)).alias("upper")).alias(c) for c in metrics])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}.{x}").alias(x) for x in ("replicates", "mean", "std_error", "lower", "upper")]) for c in metrics])))
