"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.common import landed, mapped, text_bytes
from clinrisk.llm.stats import FEATURES, document_statistics, statistics

# The most labelled rows that are gathered for a fit, taken in the order of a hash of their key.
MAX_LABELLED = 20_000
CUT = 0.3


def labelled_rows(features: DataFrame, labels: DataFrame, label: str, use: Column) -> DataFrame:
    """doc_id, FEATURES and _label (0 or 1) of all labelled documents for which ``use`` holds.

    NULL labels and keys are left out. A document labelled more than once has its lowest label.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("_label")))
    return features.where(use).select("doc_id", *FEATURES).join(known, "doc_id")


def labelled_sample(features: DataFrame, labels: DataFrame, label: str, use: Column, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and 0/1 labels of at most ``limit`` of the ``labelled_rows``."""
    rows = (labelled_rows(features, labels, label, use)
            .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(limit).select(*FEATURES, "_label").toArrow())
    x = np.column_stack([rows.column(c).to_numpy() for c in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return x, (rows.column("_label").to_numpy() > 0).astype(int)


def transformed(x: np.ndarray) -> np.ndarray:
    """Small ratios spread out, so that one stray symbol in a hundred words already counts."""
    names = np.array(FEATURES)
    out = x.astype(float)
    for c in ("symbols", "bangs", "pipes", "dup_lines", "repeats", "upper", "digits"):
        at = names == c
        out[:, at] = np.log1p(50 * x[:, at])
    return out


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid(weights . standardised features - threshold + logit(CUT)): CUT exactly at the quantile."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((transformed(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pairs_of(y: np.ndarray, partners: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the preferred and of the other document of each pair: every row meets ``partners`` of the other label."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    winners = np.concatenate([np.repeat(good, partners), rng.choice(good, len(bad) * partners)])
    return winners, np.concatenate([rng.choice(bad, len(good) * partners), np.repeat(bad, partners)])


def fit_ranking(x: np.ndarray, y: np.ndarray, partners: int = 8, l2: float = 1.0, steps: int = 30, seed: int = 7) -> Ranking:
    """P(a preferred to b) = sigmoid(strength(a) - strength(b)), fitted on pairs of a document labelled 1 and one labelled 0.

    Every labelled document gets ``partners`` of the other label. The threshold is left at 0: it follows from all labelled rows.
    Without pairs all weights are zero and every document scores CUT, that is, passes.
    """
    z = transformed(x)
    mean, scale = (z.mean(axis=0), z.std(axis=0) + 1e-9) if len(z) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = (z - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return Ranking(w, mean, scale, 0.0)
    winners, losers = pairs_of(y, partners, seed)
    difference = z[winners] - z[losers]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -500, 500)))
        gradient = difference.T @ (1 - p) - l2 * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference + l2 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking(w, mean, scale, 0.0)


def with_threshold(model: Ranking, rows: DataFrame) -> Ranking:
    """``model`` with the strength below which as large a share of all labelled ``rows`` lies as is labelled 0.

    The quantile is exact up to a millionth of the rows. If all have one label, or all weights are zero, everything passes
    whose strength is that of the least labelled row or more.
    """
    def each(batch: pa.RecordBatch):
        strength = model.strength(np.column_stack([batch.column(c).to_numpy() for c in FEATURES]))
        yield pa.RecordBatch.from_arrays([pa.array(strength), batch.column("_label")], ["strength", "_label"])

    strengths = mapped(rows.select(*FEATURES, "_label"), "strength double, _label int", each)
    bad = strengths.agg(F.avg((F.col("_label") <= 0).cast("double"))).first()[0]
    if bad is None or not model.weights.any():
        return model
    # Rows at the quantile itself are below it; the next larger strength is not.
    below = strengths.agg(F.percentile_approx("strength", F.lit(float(bad)), 1_000_000)).first()[0]
    above = strengths.where(F.col("strength") > below).agg(F.min("strength")).first()[0]
    return replace(model, threshold=(below + above) / 2 if above is not None and bad > 0 else below)


def ranking_of(stats: DataFrame, labels: DataFrame, train: Column, limit: int = MAX_LABELLED) -> Ranking:
    """Weights from at most ``limit`` labelled rows, the threshold from all of them."""
    model = fit_ranking(*labelled_sample(stats, labels, "quality", train, limit))
    return with_threshold(model, labelled_rows(stats, labels, "quality", train))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``.

    Learns from labelled rows for which ``train`` holds (an expression over doc_id). Inputs of a score are statistics of the
    text alone; empty and NULL texts score as texts without words. Repeated rows are scored one by one.
    """
    stats = landed(document_statistics(docs), "quality")
    model = ranking_of(stats, labels, train, limit)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        score = model.score(np.column_stack([batch.column(c).to_numpy() for c in FEATURES]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                                         ["doc_id", "score", "predicted"])

    return mapped(stats.select("doc_id", *FEATURES), f"doc_id {kind}, score double, predicted int", each)


def accepted(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least CUT; learned from all labelled rows of ``docs``."""
    stats = landed(document_statistics(docs), "quality")
    model = ranking_of(stats, labels, F.lit(True), limit)

    def each(batch: pa.RecordBatch):
        stats = statistics(text_bytes(batch.column("text")))
        yield batch.filter(pa.array(model.score(np.column_stack([stats[c] for c in FEATURES])) >= CUT))

    return mapped(docs, docs.schema, each)
