"""As-of lookup: for each row, the newest row of a table of changes that was there at the time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.operators.registry import version_key


def as_of(events: DataFrame, changes: DataFrame, key: str, ts: str, at: str, take: Sequence[str], tie: Column | None = None, slot: str = "day") -> DataFrame:
    """``events`` with the columns ``take`` of the change of the same ``key`` with the greatest ``at`` up to ``ts``; of equal times, that of greatest ``tie``.

    Time is cut into slots (``hour``, ``day``, ``month``). What is valid when a slot begins is carried over from slot to slot, in a table
    of one row per key and slot; inside a slot, the distinct times asked for and the changes, one per time, are put in order once. That
    gives a table of one row per key and time asked for, with which events are joined by equality: no event looks through a list, none
    is sorted as a whole row, and a key with most of the events is split like any skewed join. Rows without key or time, and those
    before the first change, get NULL; ``take`` replaces columns of that name. Changes without key or time are left out.
    """
    change = F.struct((F.lit(0) if tie is None else tie).alias("tie"), F.struct(*take).alias("row"))
    known = (changes.select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_time"), change.alias("_change"))
             .where("_key IS NOT NULL AND _time IS NOT NULL"))
    events = events.drop(*[c for c in take if c in events.columns])
    placed = events.withColumns({"_key": F.col(key), "_time": F.col(ts).cast("timestamp")})
    asked = placed.select("_key", "_time").where("_key IS NOT NULL AND _time IS NOT NULL").distinct()
    both = known.select("*", F.lit(False).alias("_asked")).unionByName(asked.select("*", F.lit(True).alias("_asked")), allowMissingColumns=True)
    times = (both.groupBy("_key", F.date_trunc(slot, "_time").alias("_slot"), "_time")
             .agg(F.max("_change").alias("_change"), F.max("_asked").alias("_asked")))
    last = F.max_by("_change", F.when(F.col("_change").isNotNull(), F.col("_time")))
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (times.groupBy("_key", "_slot").agg(last.alias("_last"))
               .select("_key", "_slot", F.last("_last", ignorenulls=True).over(before).alias("_before")))
    upto = Window.partitionBy("_key", "_slot").orderBy("_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = times.select("_key", "_slot", "_time", "_asked", F.last("_change", ignorenulls=True).over(upto).alias("_inside"))
    found = (inside.where("_asked").join(carried, ["_key", "_slot"])
             .select("_key", "_time", F.coalesce("_inside", "_before").alias("_found")))
    return placed.join(found, ["_key", "_time"], "left").select(*events.columns, *[F.col("_found")["row"][c].alias(c) for c in take])


def versions_at(events: DataFrame, versions: DataFrame, ts: str = "ts", slot: str = "day") -> DataFrame:
    """``events`` with the version of their model that was registered last up to their time; of equal times the highest."""
    return as_of(events, versions, "model", ts, "created_at", ["version"], version_key(), slot)
