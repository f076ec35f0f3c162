"""As-of lookups, counter roll-ups and latency sketches against counting by hand."""

import bisect
import collections
import math
import random
from datetime import datetime, timedelta

import pytest

from clinrisk.operators import asof, telemetry

T0 = datetime(2024, 5, 1)
EVENTS = "id long, model string, ts timestamp_ntz, version string"
VERSIONS = "model string, version string, created_at timestamp_ntz"


def history(seed, n_events, n_versions):
    rng = random.Random(seed)
    time = lambda: T0 + timedelta(hours=rng.randrange(24 * 12))
    models = ["a", "b", "c"]
    versions = [(rng.choice(models[:2]), f"1.{i // 12}.{i % 12}", time()) for i in range(n_versions)]
    events = [(i, rng.choice(models), time(), "x") for i in range(n_events)]
    return events, versions


def current(event, versions):
    numbers = lambda v: tuple(map(int, v.split(".")))
    fits = [(at, numbers(v), v) for m, v, at in versions if m is not None and at is not None and m == event[1] and event[2] is not None and at <= event[2]]
    return max(fits)[2] if fits else None


@pytest.mark.parametrize("slot", ["hour", "day", "month"])
@pytest.mark.parametrize("seed,n_versions", [(1, 40), (2, 3), (3, 0)])
def test_versions_at_the_time_of_the_event(spark, slot, seed, n_versions):
    events, versions = history(seed, 300, n_versions)
    events += [(900, None, T0, "x"), (901, "a", None, "x"), *events[:20]]
    versions += [(None, "9.9.9", T0), ("a", "9.9.9", None), *[("a", f"2.0.{i}", T0 + timedelta(days=3)) for i in (9, 10, 2)]]
    got = asof.versions_at(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), slot=slot)
    assert got.columns == ["id", "model", "ts", "version"]
    assert collections.Counter((r.id, r.version) for r in got.collect()) == collections.Counter((e[0], current(e, versions)) for e in events)


def test_as_of_takes_whole_rows_of_any_table(spark):
    baselines = spark.createDataFrame([("a", T0, 0.1, None), ("a", T0 + timedelta(days=2), 0.2, 1.0)], "model string, since timestamp_ntz, mean double, std double")
    events = spark.createDataFrame([(1, "a", T0 - timedelta(days=1)), (2, "a", T0), (3, "a", T0 + timedelta(days=5)), (4, "b", T0)], "id long, model string, ts timestamp_ntz")
    got = asof.as_of(events, baselines, "model", "ts", "since", ["mean", "std"]).orderBy("id").collect()
    assert [(r.mean, r.std) for r in got] == [(None, None), (0.1, None), (0.2, 1.0), (None, None)]
    assert asof.as_of(events.where("false"), baselines, "model", "ts", "since", ["mean"]).count() == 0


def test_no_event_is_sorted_or_windowed(spark):
    events, versions = history(4, 50, 9)
    plan = asof.versions_at(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS))._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert plan.count("Window") <= 2 and "id#" not in window.split("\n")[0]


def test_changes_of_one_slot_are_not_gathered(spark):
    """A key with thousands of changes in one slot: each time asked for is found once, and no row of the plan holds the slot's changes."""
    rng = random.Random(5)
    time = lambda: T0 + timedelta(seconds=rng.randrange(20 * 86400))
    versions = [("a", f"{i // 1000}.{i // 10 % 100}.{i % 10}", time()) for i in range(4000)] + [("a", "7.7.7", T0 - timedelta(days=70))]
    events = [(i, "a" if i % 9 else "b", time(), None) for i in range(3000)]
    got = asof.versions_at(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), slot="month")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_max" not in plan
    at = sorted((t, tuple(map(int, v.split("."))), v) for _, v, t in versions)
    times = [t for t, _, _ in at]
    assert {r.id: r.version for r in got.collect()} == {i: at[bisect.bisect_right(times, t) - 1][2] if m == "a" else None for i, m, t, _ in events}


REQUESTS = "ts timestamp_ntz, method string, endpoint string, status int, latency_s double"


def requests(seed, n):
    rng = random.Random(seed)
    return [(T0 + timedelta(minutes=rng.randrange(5000)), rng.choice(["GET", "POST", None]), rng.choice(["/a", "/b"]), rng.choice([200, 500]), rng.choice([0.0, None, -1.0, rng.random(), 10 * rng.random()]))
            for _ in range(n)]


def test_rollup_levels_add_up(spark):
    rows = requests(1, 400)
    got = telemetry.counter_rollup(spark.createDataFrame(rows, REQUESTS)).collect()
    expected = collections.Counter()
    for ts, method, endpoint, status, _ in rows:
        keys = [ts.date(), method, endpoint, status]
        for level in (0b0000, 0b0001, 0b0011, 0b0111, 0b1011, 0b1101, 0b1110, 0b1111):
            expected[(*[None if level >> (3 - i) & 1 else k for i, k in enumerate(keys)], level)] += 1
    assert {tuple(r)[:5]: r.n for r in got} == dict(expected) and len(got) == len(expected)
    assert {(r.level, r.n) for r in telemetry.counter_rollup(spark.createDataFrame([], REQUESTS)).collect()} <= {(15, 0), (15, None)}


@pytest.mark.parametrize("accuracy", [0.01, 0.05])
def test_sketches_merge_and_stay_within_their_bound(spark, accuracy):
    rows, hour = requests(2, 900), timedelta(hours=1)
    df = spark.createDataFrame(rows, REQUESTS)
    sketches = telemetry.latency_sketches(df, hour, ["endpoint"], accuracy)
    got = telemetry.sketch_quantiles(sketches, [0.0, 0.5, 0.95, 1.0], hour, 6 * hour, ["endpoint"], accuracy).collect()
    windows = collections.defaultdict(list)
    for ts, _, endpoint, _, x in rows:
        if x is not None and x >= 0:
            slot = ts.replace(minute=0, second=0)
            for i in range(1, 7):
                windows[endpoint, slot + i * hour].append(x)
    assert {(r.endpoint, r.window_end): r.n for r in got} == {k: len(v) for k, v in windows.items()}
    for r in got:
        values = sorted(windows[r.endpoint, r.window_end])
        for q, value in ((0.0, r.q00), (0.5, r.q50), (0.95, r.q95), (1.0, r.q100)):
            exact = values[math.floor(q * (len(values) - 1))]
            assert abs(value - exact) <= accuracy * exact * (1 + 1e-6)
    # Sketches of labels add up: without labels the counts are the sums.
    assert sum(r.n for r in sketches.collect()) == sum(1 for r in rows if r[4] is not None and r[4] >= 0)
    assert telemetry.latency_sketches(df.where("false"), hour).count() == 0
    with pytest.raises(ValueError):
        telemetry.sketch_quantiles(sketches, [0.5], 2 * hour, 3 * hour)


def test_alerts_and_gaps_read_the_events_once(spark, tmp_path):
    """What is read again is the small table of steps, which was written."""
    rows = [(T0 + timedelta(minutes=7 * i), "GET", "/a", 500 if i % 40 < 20 else 200, 0.1) for i in range(400)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, REQUESTS).write.parquet(path)
    events = spark.read.parquet(path)
    for out in (telemetry.alert_error_rate(events, timedelta(minutes=30), timedelta(minutes=10), timedelta(minutes=20)), telemetry.gaps(events, timedelta(minutes=5))):
        assert out.count() > 0 and path not in out._jdf.queryExecution().optimizedPlan().toString() and not any(path in f for f in out.inputFiles())
