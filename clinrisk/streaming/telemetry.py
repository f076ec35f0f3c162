"""Streaming rates and silence detection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.operators.telemetry import with_risk_level
from clinrisk.streaming.runner import event_time


def stream_rates(stream: DataFrame, by: Sequence[str], width: timedelta, lateness: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events per minute in tumbling windows per label, closed by the watermark."""
    timed = event_time(with_risk_level(stream), ts).withWatermark(ts, lateness)
    seconds = int(width.total_seconds())
    counts = timed.groupBy(F.window(ts, f"{seconds} seconds").alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n",
                         (F.col("n") * F.lit(60.0 / seconds)).alias("rate"))


def stream_sessions(stream: DataFrame, gap: timedelta, by: Sequence[str], lateness: str = "1 hour",
                    ts: str = "ts") -> DataFrame:
    """Runs of events of each source without a pause of ``gap``; the time between two runs is a silence.

    Spark merges sessions per key, so at least one key column (an instance, a model) is needed.
    """
    timed = event_time(stream, ts).withWatermark(ts, lateness)
    session = F.session_window(ts, f"{int(gap.total_seconds())} seconds").alias("session")
    return timed.groupBy(session, *by).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_seen")).select(
        F.col("session.start").alias("first_seen"), "last_seen", *by, "n")
