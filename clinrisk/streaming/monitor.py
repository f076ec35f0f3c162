"""Streaming monitoring: last-N state and sliding summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clinrisk.functions.scoring import HIGH_RISK, MEDIUM_RISK
from clinrisk.operators.monitor import RATE_LIMIT, WINDOW_SIZE, Z_LIMIT, drift, last_n, risk_counts
from clinrisk.scratch import remove
from clinrisk.streaming.runner import event_time, start_append, start_batches


def stream_last_n(stream: DataFrame, state: str, checkpoint: str, n: int = WINDOW_SIZE, group: str = "model", ts: str = "ts",
                  tie: str = "request_id", trigger: dict | None = None) -> StreamingQuery:
    """Keep the last ``n`` predictions per model as a table ``state/batch=<id>``.

    Batch ``id`` reads the state of ``id - 1`` and writes its own, so replaying a batch gives the same table. The state of
    ``id - 1`` must exist: without it the stream fails, as starting anew would forget what the checkpoint holds for done.
    Older states, which no replay can ask for, are deleted.
    """
    spark = stream.sparkSession

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = spark.read.parquet(f"{state}/batch={batch_id - 1}").unionByName(batch) if batch_id else batch
        return last_n(rows, n, group, ts, tie)

    def written(batch_id: int) -> None:
        if batch_id >= 2:
            remove(spark, f"{state}/batch={batch_id - 2}")

    return start_batches(stream, process, state, checkpoint, trigger, reread=True, written=written)


# What a model's window holds: four numbers of each of its last predictions, newest last.
_RING = "ts array<long>, tie array<long>, prediction array<double>, probability array<double>"
_OLDEST = -(1 << 62)


def _newest(ts: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Places of the last ``n`` by time and tie, in that order."""
    return np.lexsort((tie, ts))[-n:]


def live_stats(stream: DataFrame, n: int = WINDOW_SIZE, group: str = "model", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Statistics of each model's last ``n`` predictions, a row of a model for every micro-batch that has some of it (update mode).

    The last ``n`` are a ring buffer in the state of their model: a batch reads and writes the state of the models that occur in it only. Tasks
    pass on no more than ``n`` rows per model and Arrow batch, so one model's rows may be most of a batch. Rows without a
    time count as the oldest; ties are whole numbers. Columns as in ``window_stats``, with ``newest``, the latest time.
    """
    kind = stream.schema[group].dataType.simpleString()
    rows = event_time(stream, ts).select(
        F.col(group).alias("model"), F.coalesce(F.unix_micros(F.col(ts)), F.lit(_OLDEST)).alias("ts"), F.coalesce(F.col(tie).cast("long"), F.lit(_OLDEST)).alias("tie"),
        F.col("prediction").cast("double").alias("prediction"), F.col("probability").cast("double").alias("probability"))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column(0).dictionary_encode()
            codes = model.indices.fill_null(-1).to_numpy()
            order = np.lexsort((batch.column(2).to_numpy(), batch.column(1).to_numpy(), codes))
            ends = np.append(np.flatnonzero(np.diff(codes[order])) + 1, len(order))
            left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(order))
            yield batch.take(pa.array(order[left <= n]))

    def ring(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [np.array(x, t) for x, t in zip(state.get, (np.int64, np.int64, float, float))] if state.exists else None
        for f in frames:
            now = [f[c].to_numpy(t) for c, t in (("ts", np.int64), ("tie", np.int64), ("prediction", float), ("probability", float))]
            now = now if held is None else [np.concatenate(pair) for pair in zip(held, now)]
            last = _newest(now[0], now[1], n)
            held = [x[last] for x in now]
        state.update(tuple([None if v != v else v for v in x.tolist()] for x in held))
        p, predicted = held[3][~np.isnan(held[3])], held[2][~np.isnan(held[2])]
        some = len(p) > 0
        newest = int(held[0].max())
        yield pd.DataFrame({
            group: [key[0]], "total_predictions": [len(held[0])], "mean_probability": [p.mean() if some else None], "std_probability": [p.std() if some else None],
            "positive_rate": [predicted.mean() if len(predicted) else None], "min_probability": [p.min() if some else None], "max_probability": [p.max() if some else None],
            "high_risk_count": [int((p >= HIGH_RISK).sum())], "medium_risk_count": [int(((p >= MEDIUM_RISK) & (p < HIGH_RISK)).sum())], "low_risk_count": [int((p < MEDIUM_RISK).sum())],
            "newest": pd.Series([pd.NaT if newest == _OLDEST else pd.Timestamp(newest, unit="us")], dtype="datetime64[us]")})

    out = (f"{group} {kind}, total_predictions long, mean_probability double, std_probability double, positive_rate double, min_probability double,"
           " max_probability double, high_risk_count long, medium_risk_count long, low_risk_count long, newest timestamp")
    trimmed = rows.mapInArrow(trim, f"model {kind}, ts long, tie long, prediction double, probability double")
    return trimmed.groupBy("model").applyInPandasWithState(ring, out, _RING, "update", GroupStateTimeout.NoTimeout)


def stream_live_stats(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """``live_stats`` as ``out/batch=<id>``."""
    return start_batches(live_stats(stream, **options), lambda batch, _: batch, out, checkpoint, trigger, mode="update")


def stream_drift(stream: DataFrame, baselines: str, out: str, checkpoint: str, z_limit: float = Z_LIMIT, rate_limit: float = RATE_LIMIT, group: str = "model",
                 trigger: dict | None = None, **options) -> StreamingQuery:
    """Drift of the models of each micro-batch as ``out/batch=<id>``, against the baseline table at ``baselines`` as it is then.

    All models of the batch have a row, with ``drift_detected`` where there is a baseline. A replayed batch replaces its folder, so an alarm is written once.
    """
    spark = stream.sparkSession

    def compare(batch: DataFrame, batch_id: int) -> DataFrame:
        base = spark.read.parquet(baselines)
        return drift(batch, base.join(batch.select(group), group, "left_semi"), z_limit, rate_limit, group).join(batch.select(group, "newest"), group)

    return start_batches(live_stats(stream, group=group, **options), compare, out, checkpoint, trigger, reread=True, mode="update")


def last_state(query: StreamingQuery, spark: SparkSession, state: str) -> DataFrame:
    """The state after the last finished batch."""
    return spark.read.parquet(f"{state}/batch={query.lastProgress['batchId']}")


def recent_windows(stream: DataFrame, minutes: int = 60, slide: int = 5, lateness: str = "1 hour", ts: str = "ts",
                   group: str = "model") -> DataFrame:
    """Sliding summaries per model: count, mean, risk counts, positive rate.

    Rows later than the watermark are dropped and closed windows leave the state, so state is bounded by time.
    """
    timed = event_time(stream, ts).withWatermark(ts, lateness)
    window = F.window(ts, f"{minutes} minutes", f"{slide} minutes").alias("window")
    return timed.groupBy(window, group).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.avg("probability").alias("mean_probability"), *risk_counts(),
        F.avg("prediction").alias("positive_rate")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), group, "prediction_count",
        "mean_probability", "high_risk_count", "medium_risk_count", "low_risk_count", "positive_rate")


def stream_recent(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    return start_append(recent_windows(stream, **options), out, checkpoint, trigger)
