"""Binary classification metrics, curves and threshold search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.operators.newton import TASKS_PER_CORE, unpacked
from clinrisk.operators.ordered import bucketed, score_prefix

COUNTS = ["tp", "fp", "fn", "tn"]
CLASS_NAMES = ["Healthy", "Heart Disease"]
# For areas of many models: held-out scores of one model that are ordered together, scores that a task orders before it hands
# them on, and rows per fold and task from which the bucket edges are taken.
AREA_ROWS, AREA_BUFFER, EDGE_ROWS = 1 << 17, 1 << 22, 512
RUNS = "candidate int, fold int, bucket int, label int, scores binary, counts binary"


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 on a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_columns(label: str, predicted: str) -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    cells = {"tp": (y == 1) & (p == 1), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tn": (y == 0) & (p == 0)}
    return [F.count_if(cells[c]).alias(c) for c in COUNTS]


def confusion_counts(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, tp, fp, fn, tn)`` in one aggregate; a class that does not occur counts 0."""
    return df.groupBy(*by).agg(*count_columns(label, predicted))


def _metric_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
        "npv": ratio(tn, tn + fn),
    }


def _with_areas(row: DataFrame, df: DataFrame, score: str, label: str, names: Sequence[str] = ("roc_auc", "pr_auc")) -> DataFrame:
    """Add the areas to a one-row result; they are two numbers, computed first."""
    areas = score_areas(df, score, label).first()
    return row.withColumns({n: F.lit(areas[n]).cast("double") for n in names})


def all_metrics(df: DataFrame, label: str, predicted: str, score: str | None = None) -> DataFrame:
    """One row: accuracy, precision, recall, f1, specificity, npv and, with scores, roc_auc and pr_auc."""
    out = confusion_counts(df, label, predicted).select(*[e.alias(n) for n, e in _metric_columns().items()])
    return out if score is None else _with_areas(out, df, score, label)


def medical_metrics(df: DataFrame, label: str, predicted: str, score: str | None = None) -> DataFrame:
    """One row of clinical names: sensitivity, specificity, ppv, npv, the four counts, total, prevalence, roc_auc."""
    m, total = _metric_columns(), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = confusion_counts(df, label, predicted).select(
        m["recall"].alias("sensitivity"), m["specificity"].alias("specificity"), m["precision"].alias("ppv"),
        m["npv"].alias("npv"), F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), total.alias("total_patients"),
        F.try_divide((F.col("tp") + F.col("fn")).cast("double"), total.cast("double")).alias("disease_prevalence"))
    return out if score is None else _with_areas(out, df, score, label, ["roc_auc"])


def confusion_matrix(df: DataFrame, label: str, predicted: str, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """``(actual, predicted, n)``: always the four cells of the 2 x 2 grid."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    rows = F.array(*[F.struct(F.lit(names[a]).alias("actual"), F.lit(names[p]).alias("predicted"), F.col(c).alias("n"))
                     for c, a, p in cells])
    return confusion_counts(df, label, predicted).select(F.inline(rows))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``(class, precision, recall, f1, support)`` for 0, 1, accuracy (in f1), macro avg and weighted avg."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    n = tp + fp + fn + tn
    base = confusion_counts(df, label, predicted).select(
        *COUNTS, n.alias("n"), (tn + fp).alias("s0"), (tp + fn).alias("s1"), ratio(tp + tn, n).alias("acc"),
        ratio(tn, tn + fn).alias("p0"), ratio(tn, tn + fp).alias("r0"), ratio(2 * tn, 2 * tn + fp + fn).alias("f0"),
        ratio(tp, tp + fp).alias("p1"), ratio(tp, tp + fn).alias("r1"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))

    def macro(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return ratio(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), F.col("n"))

    null = F.lit(None).cast("double")
    rows = F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", null, null, F.col("acc"), F.col("n")),
        row("macro avg", macro("p"), macro("r"), macro("f"), F.col("n")),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("n")))
    return base.select(F.inline(rows))


# --------------------------------------------------------------------------------------------- areas and curves

def _area_columns() -> list[Column]:
    pos, neg, above = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("cum_pos").cast("double")
    total_pos, total_neg = F.max("total_pos").cast("double"), F.max("total_neg").cast("double")
    auc = F.try_divide(F.sum(neg * (above - pos / 2)), total_pos * total_neg)
    ap = F.try_divide(F.sum(pos * above / (above + F.col("cum_neg"))), total_pos)
    return [auc.alias("roc_auc"), ap.alias("pr_auc")]


def score_areas(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``(roc_auc, pr_auc)``: tie-aware AUC and average precision; NULL when a class is missing."""
    return score_prefix(df, score, label).agg(*_area_columns())


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return score_areas(df, score, label).select("roc_auc")


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    return score_areas(df, score, label).select("pr_auc")


def auc_by(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """``(*by, roc_auc)`` for many groups in one job."""
    return score_prefix(df, score, label, by).groupBy(*by).agg(_area_columns()[0])


def linear_aucs(packed: DataFrame, models: Sequence[tuple[int, int, np.ndarray]], rows: int, bucket_rows: int = AREA_ROWS) -> DataFrame:
    """``(candidate, fold, roc_auc)`` of linear models on the packed rows of their fold, tie-aware and exact, as ``auc_by``.

    ``models``: candidate, fold and coefficients with the intercept last; ``rows`` is the size of the largest fold. Tasks order a
    bounded number of scores at a time, count equal ones and cut them at edges into runs, so that a bucket of a model meets in one
    task as a few arrays instead of a row per score. Pairs in one bucket are compared there, those in different ones by the bucket's
    counts. The edges come from a few rows of each task; they balance the buckets and cannot change an area.
    """
    at: dict[float, list] = {}
    for candidate, fold, beta in models:
        at.setdefault(float(fold), []).append((candidate, np.asarray(beta, float)))
    ids = {f: [c for c, _ in found] for f, found in at.items()}
    betas = {f: np.vstack([b for _, b in found]) for f, found in at.items()}

    def margins(fold, x):
        # Column by column, so that a margin depends on its row only and equal rows have equal margins.
        if np.isnan(x).any():
            x = x[:, ~np.isnan(x).any(axis=0)]
        out = np.zeros((len(ids[fold]), x.shape[1]))
        for b, column in zip(betas[fold].T, x):
            out += b[:, None] * column
        return out

    buckets, edges = max(1, -(-rows // bucket_rows)), {f: [np.empty(0)] * len(c) for f, c in ids.items()}
    if buckets > 1:
        def some(batches):
            kept: dict[float, list] = {}
            for fold, _, x in unpacked(batches):
                if fold not in ids:
                    continue
                # Every stride-th row; when that gets too much, every second of those.
                found = kept.setdefault(fold, [1, 0, []])
                found[2] += [(found[1] + i, x[:, i].copy()) for i in range(-found[1] % found[0], x.shape[1], found[0])]
                found[1] += x.shape[1]
                while len(found[2]) > EDGE_ROWS:
                    found[0] *= 2
                    found[2] = [(i, row) for i, row in found[2] if i % found[0] == 0]
            for fold, (_, _, taken) in kept.items():
                scores = margins(fold, np.column_stack([row for _, row in taken]))
                yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([scores.tobytes()], pa.binary())], ["fold", "scores"])

        tasks = max(1, TASKS_PER_CORE * packed.sparkSession.sparkContext.defaultParallelism)
        taken: dict[float, list] = {}
        for r in packed.coalesce(tasks).mapInArrow(some, "fold double, scores binary").collect():  # at most EDGE_ROWS per task, fold and model
            taken.setdefault(r["fold"], []).append(np.frombuffer(r["scores"]).reshape(len(ids[r["fold"]]), -1))
        for f, found in taken.items():
            scores = np.sort(np.hstack(found), axis=1)
            places = np.arange(1, buckets) * scores.shape[1] // buckets
            edges[f] = [np.unique(s[places]) if len(s) else s for s in scores]

    def runs(fold, label, scores):
        out = []
        for candidate, edge, s in zip(ids[fold], edges[fold], scores):
            values, counts = np.unique(s, return_counts=True)
            cuts = [0, *np.searchsorted(values, edge), len(values)]
            for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    n = counts[a:b]
                    out.append((candidate, int(fold), bucket, label, values[a:b].tobytes(), b"" if n.max() == 1 else n.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int32()] * 4, pa.binary(), pa.binary()])], ["candidate", "fold", "bucket", "label", "scores", "counts"])

    def ordered(batches):
        waiting, size = {}, 0
        for fold, y, x in unpacked(batches):
            if fold not in ids:
                continue
            scores = margins(fold, x)
            waiting.setdefault((fold, int(y == 1)), []).append(scores)
            size += scores.size
            if size > AREA_BUFFER:
                yield from (runs(*key, np.hstack(found)) for key, found in waiting.items() if sum(map(np.size, found)))
                waiting, size = {}, 0
        yield from (runs(*key, np.hstack(found)) for key, found in waiting.items() if sum(map(np.size, found)))

    def compared(key, table):
        values, counts = {0: [np.empty(0)], 1: [np.empty(0)]}, {0: [np.empty(0, np.int64)], 1: [np.empty(0, np.int64)]}
        for label, scores, n in zip(*[table.column(c).to_pylist() for c in ("label", "scores", "counts")]):
            values[label].append(np.frombuffer(scores))
            counts[label].append(np.frombuffer(n, np.int64) if n else np.ones(len(scores) // 8, np.int64))
        neg, order = np.concatenate(values[0]), np.argsort(np.concatenate(values[0]))
        below = np.concatenate([[0], np.cumsum(np.concatenate(counts[0])[order])])
        neg, pos, n_pos = neg[order], np.concatenate(values[1]), np.concatenate(counts[1])
        # Twice the pairs won, a tie counting half.
        won = int((n_pos * (below[np.searchsorted(neg, pos)] + below[np.searchsorted(neg, pos, "right")])).sum())
        return pa.table({**{c: pa.array([k.as_py()], pa.int32()) for c, k in zip(("candidate", "fold", "bucket"), key)},
                         "pos": pa.array([int(n_pos.sum())], pa.int64()), "neg": pa.array([int(below[-1])], pa.int64()), "won": pa.array([won], pa.int64())})

    per_bucket = (packed.mapInArrow(ordered, RUNS).groupBy("candidate", "fold", "bucket")
                  .applyInArrow(compared, "candidate int, fold int, bucket int, pos bigint, neg bigint, won bigint"))
    lower = Window.partitionBy("candidate", "fold").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pos, neg, before = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "below"))
    return (per_bucket.withColumn("below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
            .groupBy("candidate", "fold").agg(F.sum((2 * pos * before + F.col("won")).cast("decimal(38,0)")).alias("won"), F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg"))
            .select("candidate", "fold", F.try_divide(F.col("won").cast("double"), 2 * F.col("pos") * F.col("neg")).alias("roc_auc")))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(threshold, fpr, tpr)``: the origin at threshold +inf, then descending scores without collinear points.

    A point lies on the line through its neighbours if and only if the next score has the same class counts as this one,
    so only the neighbour's counts are compared.
    """
    prefix = score_prefix(df, score, label)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    bend = F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = prefix.where(first | bend)
    # The first point also brings the origin, so that the prefix is computed once and nothing is joined or unioned.
    point = F.struct(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos").cast("double")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.select(F.inline(F.when(first, F.array(origin, point)).otherwise(F.array(point))))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, and the end point (NULL, 1, 0)."""
    prefix = score_prefix(df, score, label)
    top = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    above = (F.col("cum_pos") + F.col("cum_neg")).cast("double")
    point = F.struct(
        F.col("score").alias("threshold"), (F.col("cum_pos") / above).alias("precision"),
        F.coalesce(F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos").cast("double")), F.lit(1.0)).alias("recall"))
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return prefix.select(F.inline(F.when(top, F.array(end, point)).otherwise(F.array(point))))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_predicted, positive_fraction)`` of right-closed uniform bins; empty bins have no row."""
    index = F.lit(0)
    for edge in np.linspace(0.0, 1.0, bins + 1)[1:-1]:
        index = index + (F.col(score) > F.lit(float(edge))).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("positive_fraction"))


# --------------------------------------------------------------------------------------------- threshold search

OBJECTIVES = ["f1", "recall", "precision", "youden"]
# Start, stop and step of the threshold grid.
THRESHOLD_GRID = (0.1, 0.9, 0.01)


def threshold_grid() -> list[float]:
    return [float(t) for t in np.arange(*THRESHOLD_GRID)]


def threshold_scores(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(threshold, tp, fp, fn, tn, f1, recall, precision, youden)`` for all thresholds from one scan.

    A row is reduced to how many thresholds lie at or below its score; suffix sums over those few counts give every
    confusion matrix at once.
    """
    grid = threshold_grid()
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"))
    counts = bucketed(rows, "s", grid, "reached").groupBy("reached").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    # 81 count rows at most, each giving its share to the 80 thresholds.
    shares = counts.select("reached", "pos", "neg", F.inline(steps))
    reached = F.col("reached") >= F.col("i")
    totals = shares.groupBy("threshold").agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(reached, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~reached, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~reached, F.col("neg")).otherwise(0)).alias("tn"))
    m = _metric_columns()
    return totals.select(
        "threshold", *COUNTS, m["f1"].alias("f1"), m["recall"].alias("recall"), m["precision"].alias("precision"),
        (m["recall"] + m["specificity"] - 1).alias("youden"))


def best_threshold(df: DataFrame, score: str, label: str, objective: str = "f1") -> DataFrame:
    """One row ``(threshold, score)``: the lowest threshold of the maximal objective."""
    if objective not in OBJECTIVES:
        raise ValueError(f"Unknown metric: {objective}")
    best = F.max_by(F.struct("threshold", objective), F.struct(F.col(objective), -F.col("threshold")))
    return threshold_scores(df, score, label).agg(best.alias("best")).select(
        F.col("best.threshold").alias("threshold"), F.col(f"best.{objective}").alias("score"))


def evaluate(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """All metrics at a threshold, in one row, with the threshold and the four counts."""
    decided = df.withColumn("_pred", (F.col(score) >= F.lit(float(threshold))).cast("int"))
    counts = confusion_counts(decided, label, "_pred")
    row = counts.select(F.lit(float(threshold)).alias("threshold"), *COUNTS, *[e.alias(n) for n, e in _metric_columns().items()])
    return _with_areas(row, df, score, label)


def save_metrics(row: DataFrame, path: str) -> None:
    """JSON sink of a one-row result (so one file)."""
    row.coalesce(1).write.mode("overwrite").json(path)
