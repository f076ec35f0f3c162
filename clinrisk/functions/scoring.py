"""Decision expressions on a probability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk bounds and labels.
MEDIUM_RISK, HIGH_RISK = 0.3, 0.7


def linear_probability(features: Mapping[str, Column], coefficients: Mapping[str, float], intercept: float) -> Column:
    """Logistic probability from literal coefficients: one arithmetic expression, no vectors and no Python."""
    margin = F.lit(float(intercept))
    for name, beta in coefficients.items():
        margin = margin + F.lit(float(beta)) * features[name]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def prediction(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(float(threshold))).cast("int")


def prediction_label(pred: Column) -> Column:
    return F.when(pred.isNull(), F.lit(None)).when(pred == 1, "heart_disease").otherwise("healthy")


def risk_level(probability: Column, closed: str = "left") -> Column:
    """Left-closed levels for request scoring; ``closed="right"`` for table scoring, where 0 has no level."""
    if closed == "left":
        return (F.when(probability >= HIGH_RISK, "high").when(probability >= MEDIUM_RISK, "medium")
                .when(probability.isNotNull(), "low"))
    if closed == "right":
        return (F.when(probability <= 0, F.lit(None)).when(probability <= MEDIUM_RISK, "low")
                .when(probability <= HIGH_RISK, "medium").when(probability <= 1, "high"))
    raise ValueError(f"closed must be 'left' or 'right', got {closed!r}")


def confidence(probability: Column, pred: Column) -> Column:
    return F.when(pred == 1, probability).otherwise(F.lit(1.0) - probability)


def rounded(value: Column, digits: int) -> Column:
    return F.round(value, digits)
