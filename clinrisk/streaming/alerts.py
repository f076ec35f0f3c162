"""Live alerts: conditions that hold for a time and sources that fall silent, with event-time timers per key.

Tasks first reduce events to time steps, so that a key's state gets a few rows of each task, however many events there are.
Nothing is decided before the watermark has passed it, so the outcome does not depend on how events fall into micro-batches;
timers bring a key up when the watermark moves on without events of its own. Where a source can be the only one, a ``clock`` stream of
other times moves the watermark on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clinrisk.operators.telemetry import SILENCE_HOLD, SILENCE_WINDOW
from clinrisk.streaming.runner import event_time

STEPS = "key string, slot long, first timestamp, last timestamp, n long, hits long"
SILENCE = "key string, status string, last_seen timestamp, firing_since timestamp, resolved_at timestamp"
HELD = "key string, status string, pending_since timestamp, firing_since timestamp, resolved_after timestamp, n_evaluations long"
FIRING, RESOLVED = "firing", "resolved"
# The key of tables that are watched as a whole.
ALL = "all"


def _micros(d: timedelta) -> int:
    return round(d.total_seconds() * 1_000_000)


def _time(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros, unit="us")


def _counted(stream: DataFrame, step: int, by: str | None, hit: Column, ts: str, clock: DataFrame | None, lateness: str) -> DataFrame:
    """Rows of each key and step in a task's batch, with the watermark; clock times have no rows and no key."""
    events = event_time(stream, ts).where(F.col(ts).isNotNull()).select(
        F.coalesce(F.col(by).cast("string"), F.lit("")).alias("key") if by else F.lit(ALL).alias("key"), F.col(ts).alias("ts"), F.coalesce(hit, F.lit(False)).alias("hit"))
    if clock is not None:
        events = events.unionByName(event_time(clock, ts).where(F.col(ts).isNotNull()).select(F.lit(None).cast("string").alias("key"), F.col(ts).alias("ts"), F.lit(False).alias("hit")))

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = batch.column(1)
            slot = pa.array(np.floor_divide(ts.cast(pa.int64()).to_numpy(), step) * step)
            table = pa.table({"key": batch.column(0), "slot": slot, "ts": ts, "hit": pc.cast(batch.column(2), pa.int64())})
            found = table.group_by(["key", "slot"]).aggregate([("ts", "min"), ("ts", "max"), ("ts", "count"), ("hit", "sum")])
            yield from found.select(["key", "slot", "ts_min", "ts_max", "ts_count", "hit_sum"]).rename_columns(["key", "slot", "first", "last", "n", "hits"]).to_batches()

    steps = events.mapInArrow(reduce_, STEPS).withWatermark("last", lateness)
    # Clock times must not go before they have moved the watermark; a condition on its column stays above it.
    return steps.where(F.when(F.col("key").isNotNull(), F.col("last").isNotNull()).otherwise(False))


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> np.ndarray:
    parts = [np.column_stack([f[c].to_numpy("datetime64[us]").astype(np.int64) if f[c].dtype.kind == "M" else f[c].to_numpy(np.int64) for c in columns]) for f in frames]
    return np.concatenate(parts) if parts else np.empty((0, len(columns)), np.int64)


def _remember(state: GroupState, values: tuple, due: int | None) -> None:
    """Keep ``values`` and come back when the watermark reaches ``due`` (microseconds), which it has not yet."""
    state.update(values)
    if due is not None:
        state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))


def stream_silence(stream: DataFrame, by: str | None = None, window: timedelta = SILENCE_WINDOW, hold: timedelta = SILENCE_HOLD, ts: str = "ts",
                   lateness: str = "1 hour", clock: DataFrame | None = None) -> DataFrame:
    """``(key, status, last_seen, firing_since, resolved_at)``: a row when a key has been silent for ``window`` + ``hold``, and one when it is back.

    The first row comes while the silence lasts. A silence that is over before the watermark reaches its limit gives only the second.
    Events without a time are left out; those without a key are a key of their own, "". State is one time span per key, and one for each
    silence that the watermark has not passed.
    """
    bound = _micros(window + hold)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, fired = state.get if state.exists else ([], [], False)
        spans = sorted([*zip(starts, ends), *map(tuple, _rows(frames, "first", "last").tolist())])
        merged: list[list[int]] = []
        for start, end in spans:
            if merged and start - merged[-1][1] <= bound:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        watermark, out = state.getCurrentWatermarkMs() * 1000, []
        while len(merged) > 1 and merged[1][0] <= watermark:
            (_, end), (start, _) = merged[:2]
            out.append((key[0], RESOLVED, _time(end), _time(end + bound), _time(start)))
            merged, fired = merged[1:], False
        due = merged[1][0] if len(merged) > 1 else None
        if merged and not fired:
            limit = merged[0][1] + bound
            if limit <= watermark:
                fired = True
                out.append((key[0], FIRING, _time(merged[0][1]), _time(limit), None))
            else:
                due = limit if due is None else min(due, limit)
        _remember(state, ([s for s, _ in merged], [e for _, e in merged], fired), due)
        if out:
            yield _frame(out, SILENCE)

    steps = _counted(stream, bound, by, F.lit(False), ts, clock, lateness)
    return steps.groupBy("key").applyInPandasWithState(watch, SILENCE, "starts array<long>, ends array<long>, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_held(stream: DataFrame, condition: Column, limit: float, width: timedelta, step: timedelta, hold: timedelta, by: str | None = None, ts: str = "ts",
                lateness: str = "1 hour", clock: DataFrame | None = None) -> DataFrame:
    """``(key, status, pending_since, firing_since, resolved_after, n_evaluations)`` of an alert on the share of events with ``condition``.

    At the end of every step the share in the window before is compared with ``limit``; a run of breaches that lasts ``hold`` gives a row
    when it has lasted so long, and one when it is over. A window without events ends a run. State is a window of steps per key.
    """
    if width % step:
        raise ValueError("The window width must be a multiple of the step")
    wide, stride, lasting = _micros(width), _micros(step), _micros(hold)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, counts, hits, decided, pending, last, many, fired = state.get if state.exists else ([], [], [], 0, None, None, 0, False)
        table = {s: [n, h] for s, n, h in zip(slots, counts, hits)}
        for s, n, h in _rows(frames, "slot", "n", "hits").tolist():
            have = table.setdefault(s, [0, 0])
            have[0] += n
            have[1] += h
        watermark, out = state.getCurrentWatermarkMs() * 1000, []
        ends = sorted({e for s in table for e in range(s + stride, s + wide + 1, stride) if e > decided})

        def over() -> None:
            nonlocal pending, last, many, fired
            if pending is not None and last - pending >= lasting:
                out.append((key[0], RESOLVED, _time(pending), _time(pending + lasting), _time(last), many))
            pending, last, many, fired = None, None, 0, False

        for e in ends:
            if e > watermark:
                break
            decided = e
            inside = [table[s] for s in range(e - wide, e, stride) if s in table]
            if sum(h for _, h in inside) / sum(n for n, _ in inside) <= limit:
                continue
            if pending is not None and e - last > stride:
                over()
            pending, last, many = e if pending is None else pending, e, many + 1
            if last - pending >= lasting and not fired:
                fired = True
                out.append((key[0], FIRING, _time(pending), _time(pending + lasting), None, many))
        if pending is not None and watermark >= last + stride:
            over()
        table = {s: v for s, v in table.items() if s + wide > decided}
        later = [e for e in ends if e > watermark]
        due = min([*later[:1], *([last + stride] if pending is not None else [])], default=None)
        _remember(state, (list(table), [v[0] for v in table.values()], [v[1] for v in table.values()], decided, pending, last, many, fired), due)
        if out:
            yield _frame(out, HELD)

    kept = "slots array<long>, counts array<long>, hits array<long>, decided long, pending long, last long, many long, fired boolean"
    return _counted(stream, stride, by, condition, ts, clock, lateness).groupBy("key").applyInPandasWithState(watch, HELD, kept, "append", GroupStateTimeout.EventTimeTimeout)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c.split()[0]: "datetime64[us]" for c in schema.split(", ") if c.endswith(" timestamp")})
