"""Structured log records of predictions, batches, drift and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.functions.scoring import prediction_label, risk_level
from clinrisk.operators.monitor import RATE_LIMIT, Z_LIMIT

LOGGER = "clinrisk.predictions"


def prediction_events(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One record per scored row; probability to 4 and latency to 2 decimals; ``extra`` columns are carried along."""
    return df.select(
        "ts", F.lit("prediction").alias("event_type"), F.col("patient_id").cast("string").alias("patient_id"), "prediction",
        prediction_label(F.col("prediction")).alias("prediction_label"), F.round("probability", 4).alias("probability"),
        risk_level(F.col("probability")).alias("risk_level"), F.round(F.col("latency_s") * 1000, 2).alias("latency_ms"),
        *(extra or []))


def batch_events(df: DataFrame, by: str = "batch_id") -> DataFrame:
    """One record per batch: size, high-risk count and rate, total and mean latency."""
    high = F.count_if(risk_level(F.col("probability")) == "high")
    rows = df.groupBy(by).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("batch_size"), high.alias("high_risk_count"),
                              F.sum(F.col("latency_s") * 1000).alias("total"))
    return rows.select(
        by, "ts", F.lit("batch_prediction").alias("event_type"), "batch_size", "high_risk_count",
        F.round(F.col("high_risk_count") / F.col("batch_size"), 4).alias("high_risk_rate"),
        F.round("total", 2).alias("total_latency_ms"), F.round(F.col("total") / F.col("batch_size"), 2).alias("avg_latency_ms"))


def drift_events(drift: DataFrame, z_limit: float = Z_LIMIT, rate_limit: float = RATE_LIMIT, group: str = "model") -> DataFrame:
    """One record per model and kind of drift that exceeded its limit."""
    def kind(name: str, value: str, limit: float) -> Column:
        return F.when(F.col(value) > limit, F.struct(
            F.lit(name).alias("drift_type"), F.round(value, 4).alias("drift_value"), F.lit(limit).alias("threshold")))

    kinds = F.array_compact(F.array(kind("probability", "probability_drift_zscore", z_limit),
                                    kind("positive_rate", "positive_rate_drift", rate_limit)))
    found = drift.where("drift_detected").select(group, F.lit("drift_detected").alias("event_type"), F.inline(kinds))
    return found


def error_events(validated: DataFrame, key: str, error_type: str = "validation_error") -> DataFrame:
    """One record per error message of the rejected rows."""
    return validated.where(F.size("errors") > 0).select(
        key, F.lit("error").alias("event_type"), F.lit(error_type).alias("error_type"),
        F.explode("errors").alias("error_message"))


def to_log_lines(events: DataFrame, message: str, level: str = "INFO", logger: str = LOGGER, ts: str = "ts") -> DataFrame:
    """``(value STRING)``: one JSON line per event, the envelope first and the event fields at top level."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = [c for c in events.columns if c != ts]
    return events.select(F.to_json(F.struct(
        stamp.alias("timestamp"), F.lit(level).alias("level"), F.lit(logger).alias("logger"), F.lit(message).alias("message"),
        *fields)).alias("value"))


def write_log(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Sink of log lines: text files, one JSON object per line."""
    lines.write.mode(mode).text(path)
