"""Service telemetry over the prediction-event table: counters, histograms, rates, quantiles, alerts.

Every windowed operator first counts events per small time step (map-side combined); overlapping windows, gaps and hold
times are then worked out on the step table, whose size depends on the covered time and not on the number of events.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.functions.scoring import risk_level
from clinrisk.scratch import landed

# Latency bucket bounds in seconds and alert limits.
LATENCY_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
SLOW_SECONDS = 1.0
ERROR_RATE_LIMIT, LATENCY_LIMIT, HIGH_RISK_LIMIT = 0.05, 1.0, 0.5
ERROR_WINDOW, LATENCY_WINDOW, RISK_WINDOW = timedelta(minutes=5), timedelta(minutes=5), timedelta(minutes=10)
SILENCE_WINDOW, SILENCE_HOLD = timedelta(minutes=15), timedelta(minutes=30)
EVALUATION_STEP = timedelta(minutes=1)
# The bucket of values that have no logarithm.
ZERO_BUCKET = -2147483648


def with_risk_level(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_level", risk_level(F.col("probability")))


def prediction_counter(df: DataFrame) -> DataFrame:
    return with_risk_level(df).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def request_counter(df: DataFrame) -> DataFrame:
    return df.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


def counter_rollup(df: DataFrame, by: Sequence[str] = ("method", "endpoint", "status"), ts: str = "ts") -> DataFrame:
    """``(day, *by, level, n)``: requests per day and labels, and their sums over ever more of them; ``level`` is Spark's grouping_id.

    Sets: all labels; without the last, the last two, ...; days alone; each label alone; everything. Requests are counted once at the
    finest level, and only those counts are repeated for the sets.
    """
    keys = ["day", *by]
    finest = df.withColumn("day", F.to_date(ts)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sets = [keys[:i] for i in range(len(keys), 0, -1)] + [[c] for c in by] + [[]]
    return finest.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.sum("n").alias("n"), F.grouping_id().alias("level")).select(*keys, F.col("level").cast("long"), "n")


def totals(df: DataFrame) -> DataFrame:
    """One row ``(total, high_risk)``."""
    return with_risk_level(df).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("risk_level") == "high").alias("high_risk"))


def slow_requests(df: DataFrame, seconds: float = SLOW_SECONDS) -> DataFrame:
    return df.where(F.col("latency_s") > seconds)


def _le(bound: float | None) -> str:
    return "+Inf" if bound is None else str(bound)


def latency_histogram(df: DataFrame, bounds: Sequence[float] = LATENCY_BUCKETS, latency: str = "latency_s") -> DataFrame:
    """``(le, n)``: cumulative counts per bound and +Inf, from one aggregate."""
    cells = [F.count_if(F.col(latency) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = df.agg(*cells, F.count(latency).alias("all"))
    entries = [F.struct(F.lit(_le(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return row.select(F.inline(F.array(*entries, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))))


# --------------------------------------------------------------------------------------------- windows

def _text(d: timedelta) -> str:
    return f"{int(d.total_seconds() * 1_000_000)} microseconds"


def windowed(df: DataFrame, aggregates: dict[str, tuple[Column, str]], width: timedelta, step: timedelta | None = None,
             by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``(*by, window_start, window_end, *aggregates)`` of tumbling or sliding event-time windows that hold any event.

    ``aggregates`` maps a name to (aggregate per step, function merging steps: sum, min or max). Events are aggregated once
    per step; only step rows are repeated for overlapping windows, never events.
    """
    step = width if step is None else step
    if width % step:
        raise ValueError("The window width must be a multiple of the step")
    slot = F.window(ts, _text(step))["start"]
    steps = df.groupBy(*by, slot.alias("slot")).agg(*[a.alias(n) for n, (a, _) in aggregates.items()])
    if width == step:
        return steps.select(*by, F.col("slot").alias("window_start"), (F.col("slot") + _interval(width)).alias("window_end"),
                            *aggregates)
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    offsets = F.sequence(F.lit(0), F.lit(width // step - 1))
    spread = steps.withColumn("_i", F.explode(offsets))
    end = F.col("slot") + _interval(step) + F.make_dt_interval(secs=(F.col("_i") * step.total_seconds()).cast("decimal(18,6)"))
    merged = spread.withColumn("window_end", end).groupBy(*by, "window_end").agg(
        *[merge[how](n).alias(n) for n, (_, how) in aggregates.items()])
    return merged.select(*by, (F.col("window_end") - _interval(width)).alias("window_start"), "window_end", *aggregates)


def _interval(d: timedelta) -> Column:
    return F.expr(f"INTERVAL '{d.total_seconds():f}' SECOND")


def rates(df: DataFrame, by: Sequence[str], width: timedelta, step: timedelta | None = None,
          per: timedelta = timedelta(minutes=1)) -> DataFrame:
    """Events per ``per`` (a minute) in each window and label combination."""
    counts = windowed(df, {"n": (F.count(F.lit(1)), "sum")}, width, step, by)
    return counts.withColumn("rate", F.col("n") * F.lit(per.total_seconds() / width.total_seconds()))


def latency_quantiles(df: DataFrame, quantiles: Sequence[float] = (0.5, 0.95), width: timedelta = LATENCY_WINDOW,
                      step: timedelta | None = None, bounds: Sequence[float] = LATENCY_BUCKETS,
                      latency: str = "latency_s") -> DataFrame:
    """``(window_start, window_end, n, q50, q95, ...)`` interpolated inside cumulative histogram buckets.

    Rank q * n falls into the first bucket whose cumulative count reaches it; the lowest bucket starts at 0, and a rank
    beyond the last finite bound gives that bound.
    """
    cells = {f"b{i}": (F.count_if(F.col(latency) <= b), "sum") for i, b in enumerate(bounds)}
    table = windowed(df, {"n": (F.count(latency), "sum"), **cells}, width, step)

    def estimate(q: float) -> Column:
        rank, out = F.col("n") * F.lit(q), None
        for i, b in enumerate(bounds):
            low, before = (0.0, F.lit(0)) if i == 0 else (bounds[i - 1], F.col(f"b{i - 1}"))
            inside = F.lit(low) + F.lit(b - low) * F.coalesce(F.try_divide(rank - before, F.col(f"b{i}") - before), F.lit(0.0))
            reached = F.col(f"b{i}") >= rank
            out = F.when(reached, inside) if out is None else out.when(reached, inside)
        return out.otherwise(F.lit(bounds[-1]))

    named = {f"q{round(q * 100):02d}": F.when(F.col("n") > 0, estimate(q)) for q in quantiles}
    return table.select("window_start", "window_end", "n", *[e.alias(k) for k, e in named.items()])


# --------------------------------------------------------------------------------------------- sketches

# Values in one bucket of a sketch differ by less than this share on either side of its middle.
SKETCH_ACCURACY = 0.01


def _growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def latency_sketches(df: DataFrame, step: timedelta, by: Sequence[str] = (), accuracy: float = SKETCH_ACCURACY, latency: str = "latency_s", ts: str = "ts") -> DataFrame:
    """``(*by, slot, n, sketch)``: values per time step by logarithmic bucket, as a map from bucket to count; zeros have a bucket of their own.

    Sketches are a table to be kept: any window of whole steps, and any merging of labels, is a sum of them, and what they
    estimate is within ``accuracy`` of a value of the exact rank. Their size follows from the range of values, not from their number.
    Values that are NULL, NaN or negative are left out.
    """
    x = F.col(latency).cast("double")
    bucket = F.when(x > 0, F.ceil(F.round(F.ln(x) / F.lit(math.log(_growth(accuracy))), 9)).cast("int")).otherwise(F.lit(ZERO_BUCKET))
    counts = df.where((x >= 0) & ~F.isnan(x)).groupBy(*by, F.window(ts, _text(step))["start"].alias("slot"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by, "slot").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: Sequence[float], step: timedelta, width: timedelta, by: Sequence[str] = (), accuracy: float = SKETCH_ACCURACY) -> DataFrame:
    """``(*by, window_end, n, q50, ...)`` of the windows of ``width`` that end at each step, merged from the steps' sketches.

    A quantile is the middle of the bucket of the value with rank floor(q (n - 1)), counted from 0.
    """
    if width % step:
        raise ValueError("The window width must be a multiple of the step")
    entries = sketches.select(*by, "slot", F.explode("sketch").alias("bucket", "m"))
    spread = entries.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(width // step))))
    end = F.col("slot") + F.make_dt_interval(secs=(F.col("_i") * step.total_seconds()).cast("decimal(18,6)"))
    merged = spread.groupBy(*by, end.alias("window_end"), "bucket").agg(F.sum("m").alias("m"))
    lists = merged.groupBy(*by, "window_end").agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "m"))).alias("cells"))
    growth = _growth(accuracy)

    def estimate(q: float) -> Column:
        rank = F.floor(F.lit(q) * (F.col("n") - 1))
        seek = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket")), lambda a, c: F.struct(
            (a["seen"] + c["m"]).alias("seen"), F.when(a["bucket"].isNull() & (a["seen"] + c["m"] > rank), c["bucket"]).otherwise(a["bucket"]).alias("bucket")))["bucket"]
        return F.when(seek == ZERO_BUCKET, 0.0).otherwise(F.lit(2.0) * F.pow(F.lit(growth), seek) / F.lit(growth + 1))

    return lists.select(*by, "window_end", "n", *[estimate(q).alias(f"q{round(q * 100):02d}") for q in quantiles])


# --------------------------------------------------------------------------------------------- alerts

def held(evaluations: DataFrame, step: timedelta, hold: timedelta) -> DataFrame:
    """Alert periods ``(pending_since, firing_since, resolved_after, n_evaluations)`` from ``(at, breach)`` rows.

    A period is a run of true evaluations one step apart that lasts at least ``hold``. Runs are found and numbered inside
    days; only a table of one row per day is ordered as a whole, which tells each day the last breach before it and how
    many runs began. The breaches, a row per step at most, are written once, so that events are read once.
    """
    breaches = landed(evaluations.where("breach").select("at"), "breaches").withColumn("_day", F.to_date("at"))
    inside, days = Window.partitionBy("_day").orderBy("at"), Window.orderBy("_day")
    last = breaches.groupBy("_day").agg(F.max("at").alias("_last")).select("_day", F.lag("_last").over(days).alias("_before"))
    previous = F.coalesce(F.lag("at").over(inside), F.col("_before"))
    starts = F.when(previous.isNull() | (F.col("at") - previous > _interval(step)), 1).otherwise(0)
    marked = breaches.join(last, "_day").withColumn("_start", starts)
    began = F.sum("_begun").over(days.rowsBetween(Window.unboundedPreceding, -1))
    earlier = marked.groupBy("_day").agg(F.sum("_start").alias("_begun")).select("_day", F.coalesce(began, F.lit(0)).alias("_earlier"))
    numbered = marked.join(earlier, "_day").withColumn(
        "_run", F.col("_earlier") + F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("_run").agg(F.min("at").alias("pending_since"), F.max("at").alias("resolved_after"),
                                        F.count(F.lit(1)).alias("n_evaluations"))
    return (runs.where(F.col("resolved_after") - F.col("pending_since") >= _interval(hold))
            .select("pending_since", (F.col("pending_since") + _interval(hold)).alias("firing_since"), "resolved_after",
                    "n_evaluations"))


def _share_alert(df: DataFrame, condition: Column, limit: float, width: timedelta, step: timedelta, hold: timedelta) -> DataFrame:
    table = windowed(df, {"n": (F.count(F.lit(1)), "sum"), "hits": (F.count_if(condition), "sum")}, width, step)
    breach = F.col("hits") / F.col("n") > limit
    return held(table.select(F.col("window_end").alias("at"), breach.alias("breach")), step, hold)


def alert_error_rate(df: DataFrame, width: timedelta = ERROR_WINDOW, step: timedelta = EVALUATION_STEP,
                     hold: timedelta = ERROR_WINDOW, limit: float = ERROR_RATE_LIMIT) -> DataFrame:
    """Share of status 5xx above the limit."""
    return _share_alert(df, F.col("status").between(500, 599), limit, width, step, hold)


def alert_high_risk(df: DataFrame, width: timedelta = RISK_WINDOW, step: timedelta = EVALUATION_STEP,
                    hold: timedelta = RISK_WINDOW, limit: float = HIGH_RISK_LIMIT) -> DataFrame:
    """Share of high-risk predictions among all predictions above the limit."""
    return _share_alert(df, risk_level(F.col("probability")) == "high", limit, width, step, hold)


def quantile_exceeds(df: DataFrame, q: float, limit: float, width: timedelta, step: timedelta | None = None,
                     latency: str = "latency_s") -> DataFrame:
    """``(window_start, window_end, n, breach)``: is the exact interpolated q-quantile of the window above the limit?

    The quantile lies between two neighbouring order statistics. The number of values up to the limit tells whether both
    are on one side of it; if not, they are the largest value up to and the smallest value above the limit. All four are
    mergeable aggregates, so no window's values are ever gathered.
    """
    x = F.col(latency)
    table = windowed(df, {
        "n": (F.count(x), "sum"), "upto": (F.count_if(x <= limit), "sum"),
        "a": (F.max(F.when(x <= limit, x)), "max"), "b": (F.min(F.when(x > limit, x)), "min"),
    }, width, step)
    position = F.lit(q) * (F.col("n") - 1)
    low = F.floor(position)
    straddled = F.col("a") + (F.col("b") - F.col("a")) * (position - low) > limit
    breach = F.when(low >= F.col("upto"), True).when(low + 1 < F.col("upto"), False).otherwise(F.coalesce(straddled, F.lit(False)))
    return table.where("n > 0").select("window_start", "window_end", "n", breach.alias("breach"))


def alert_latency(df: DataFrame, width: timedelta = LATENCY_WINDOW, step: timedelta = EVALUATION_STEP,
                  hold: timedelta = LATENCY_WINDOW, limit: float = LATENCY_LIMIT, q: float = 0.95) -> DataFrame:
    """95th percentile of latency above the limit."""
    table = quantile_exceeds(df, q, limit, width, step)
    return held(table.select(F.col("window_end").alias("at"), "breach"), step, hold)


def gaps(df: DataFrame, longer_than: timedelta, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``(*by, last_seen, next_seen, gap_seconds)`` of the pauses between neighbouring events longer than a bound.

    Two events in the same slot of that width are never further apart, so the first and last time of each slot are enough.
    The next slot is looked for inside the day; for a day's last slot it is the first one of the next day with events, from
    a table of one row per day. The slots are written once, so that events are read once.
    """
    slot = F.window(ts, _text(longer_than))["start"]
    ends = landed(df.groupBy(*by, slot.alias("slot")).agg(F.min(ts).alias("first"), F.max(ts).alias("last_seen")), "slots")
    ends = ends.withColumn("_day", F.to_date("slot")).withColumn("_group", F.struct(*by) if by else F.lit(0))
    after = (ends.groupBy("_group", "_day").agg(F.min("first").alias("_first"))
             .withColumn("_after", F.lead("_first").over(Window.partitionBy("_group").orderBy("_day"))).drop("_first"))
    after = after.select(F.col("_group").alias("_g"), F.col("_day").alias("_d"), "_after")
    joined = ends.join(after, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_day") == F.col("_d")))
    following = F.coalesce(F.lead("first").over(Window.partitionBy("_group", "_day").orderBy("slot")), F.col("_after"))
    pauses = joined.withColumn("next_seen", following).where(F.col("next_seen") - F.col("last_seen") > _interval(longer_than))
    seconds = (F.col("next_seen").cast("timestamp").cast("double") - F.col("last_seen").cast("timestamp").cast("double"))
    return pauses.select(*by, "last_seen", "next_seen", seconds.alias("gap_seconds"))


def alert_silence(df: DataFrame, window: timedelta = SILENCE_WINDOW, hold: timedelta = SILENCE_HOLD) -> DataFrame:
    """No event for ``window``, and that held for ``hold``: ``(firing_since, resolved_at)``."""
    quiet = gaps(df, window + hold)
    return quiet.select((F.col("last_seen") + _interval(window + hold)).alias("firing_since"), F.col("next_seen").alias("resolved_at"))


def heartbeat_gaps(df: DataFrame, longer_than: timedelta = timedelta(minutes=1), by: str = "instance") -> DataFrame:
    """Pauses of each instance longer than the bound."""
    return gaps(df, longer_than, [by])
