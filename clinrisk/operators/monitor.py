"""Prediction monitoring: last-N windows, statistics, baselines, drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.functions.scoring import HIGH_RISK, MEDIUM_RISK
from clinrisk.operators.ordered import top_n_per_group

WINDOW_SIZE = 1000
Z_LIMIT = 2.0
RATE_LIMIT = 0.1
# Recommendation and status texts.
RETRAIN = "Investigate model performance - consider retraining"
NO_ACTION = "No action needed"
NO_BASELINE = "Baseline not set"
NO_PREDICTIONS = "No predictions recorded"


def last_n(df: DataFrame, n: int = WINDOW_SIZE, group: str = "model", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """The last ``n`` predictions of each model by ``(ts, request_id)``."""
    return top_n_per_group(df, group, ts, tie, n)


def after_reset(df: DataFrame, reset_at: datetime, ts: str = "ts") -> DataFrame:
    """Monitoring restarted at a time: earlier rows are left out, nothing is deleted."""
    return df.where(F.col(ts) >= F.lit(reset_at).cast(df.schema[ts].dataType))


def risk_counts(p: str = "probability") -> list[Column]:
    x = F.col(p)
    return [F.count_if(x >= HIGH_RISK).alias("high_risk_count"),
            F.count_if((x >= MEDIUM_RISK) & (x < HIGH_RISK)).alias("medium_risk_count"),
            F.count_if(x < MEDIUM_RISK).alias("low_risk_count")]


def window_stats(df: DataFrame, group: str = "model") -> DataFrame:
    """Per model: count, mean, population std, positive rate, min, max and counts per risk level."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg("probability").alias("mean_probability"),
        F.stddev_pop("probability").alias("std_probability"), F.avg("prediction").alias("positive_rate"),
        F.min("probability").alias("min_probability"), F.max("probability").alias("max_probability"), *risk_counts())


def baseline(df: DataFrame, group: str = "model") -> DataFrame:
    """Per model ``(baseline_mean_prob, baseline_std_prob, baseline_positive_rate)`` of reference scores."""
    return window_stats(df, group).select(
        group, F.col("mean_probability").alias("baseline_mean_prob"), F.col("std_probability").alias("baseline_std_prob"),
        F.col("positive_rate").alias("baseline_positive_rate"))


def drift(stats: DataFrame, base: DataFrame, z_limit: float = Z_LIMIT, rate_limit: float = RATE_LIMIT,
          group: str = "model") -> DataFrame:
    """Compare window statistics with baselines, one row per model; without a baseline the row carries only a status.

    Both sides are already aggregated to a row per model, so the join is small however many predictions there are.
    """
    joined = stats.join(base, group, "full_outer")
    has_base, has_stats = F.col("baseline_mean_prob").isNotNull(), F.col("total_predictions").isNotNull()
    usable = has_base & has_stats
    z = F.when(F.col("baseline_std_prob") > 0,
               F.abs(F.col("mean_probability") - F.col("baseline_mean_prob")) / F.col("baseline_std_prob")).otherwise(0.0)
    rate = F.abs(F.col("positive_rate") - F.coalesce("baseline_positive_rate", F.lit(0.0)))
    measured = joined.select(
        group, F.when(~has_base, NO_BASELINE).when(~has_stats, NO_PREDICTIONS).otherwise("ok").alias("status"),
        F.when(usable, z).alias("probability_drift_zscore"), F.when(usable, rate).alias("positive_rate_drift"),
        F.col("mean_probability").alias("current_mean_prob"), "baseline_mean_prob",
        F.col("positive_rate").alias("current_positive_rate"), "baseline_positive_rate")
    detected = (F.col("probability_drift_zscore") > z_limit) | (F.col("positive_rate_drift") > rate_limit)
    return measured.withColumn("drift_detected", detected).withColumn(
        "recommendation", F.when(F.col("drift_detected"), RETRAIN).when(~F.col("drift_detected"), NO_ACTION))


def recent_filter(df: DataFrame, as_of: datetime | str, minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Rows of the last ``minutes`` before ``as_of`` (inclusive), a constant comparison that reaches the scan."""
    cutoff = F.lit(str(as_of)).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return df.where(F.col(ts) >= cutoff)


def recent_summary(df: DataFrame, as_of: datetime | str, minutes: int = 60, ts: str = "ts") -> DataFrame:
    """One row: count, mean, risk counts, positive rate and ``status`` (an error text when there is nothing)."""
    row = recent_filter(df, as_of, minutes, ts).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.avg("probability").alias("mean_probability"), *risk_counts(),
        F.avg("prediction").alias("positive_rate"))
    empty = F.col("prediction_count") == 0
    return row.select(
        F.lit(minutes).alias("period_minutes"), "*",
        F.when(empty, f"No predictions in last {minutes} minutes").otherwise("ok").alias("status"))
