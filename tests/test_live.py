"""Live alerts, last-N statistics and drift as streams, against their batch forms, in any order of batches and after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clinrisk.operators import monitor, telemetry
from clinrisk.scratch import scratch_path
from clinrisk.streaming import alerts, runner
from clinrisk.streaming import monitor as SM

T0 = datetime(2024, 3, 1)
SCHEMA = "request_id bigint, model string, ts timestamp_ntz, prediction int, probability double, status int"
MINUTE = timedelta(minutes=1)
OPEN = {"maxFilesPerTrigger": 1}


def events(seed, n, pause=0.04):
    rng, t, rows = random.Random(seed), T0, []
    for i in range(n):
        t += timedelta(seconds=rng.randrange(1, 90)) if rng.random() > pause else timedelta(minutes=rng.randrange(20, 120))
        bad = (i // 40) % 3 == 1
        rows.append((i, rng.choice(["a", "b", None]), t, i % 2, round(rng.random(), 3), 500 if bad and rng.random() < 0.6 else 200))
    return rows


def files(spark, rows, folder, count, disorder=0):
    """``rows`` as ``count`` files, in time order up to a shuffle of neighbours."""
    rng, rows = random.Random(1), list(rows)
    for i in range(0, len(rows) - disorder, max(disorder, 1)) if disorder else ():
        part = rows[i:i + disorder]
        rng.shuffle(part)
        rows[i:i + disorder] = part
    size = -(-len(rows) // count)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return runner.read_table_stream(spark, folder, "*.parquet", SCHEMA, max_files=1)


def run(spark, make, folder, out, checkpoint):
    return runner.finish(runner.start_append(make(stream_of(spark, folder)), out, checkpoint))


def silences(spark, out):
    return sorted((r.key, r.status, r.firing_since, r.resolved_at) for r in spark.read.parquet(out).collect())


def quiet(rows, by, bound, watermark):
    """Silences by hand: those that are over, and those that last, as of a watermark."""
    times, out = {}, []
    for r in rows:
        times.setdefault(("" if r[1] is None else r[1]) if by else "all", []).append(r[2])
    for key, ts in times.items():
        ts.sort()
        for x, y in zip(ts, ts[1:]):
            if y - x > bound and y <= watermark:
                out.append((key, "resolved", x + bound, y))
    return sorted(out)


@pytest.mark.parametrize("by", [None, "model"])
def test_silences_equal_the_batch_and_survive_a_restart(spark, tmp_path, by):
    rows = events(3, 400)
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    make = lambda s: alerts.stream_silence(s, by, 15 * MINUTE, 10 * MINUTE, lateness="30 minutes")
    files(spark, rows[:200], folder, 3, disorder=5)
    run(spark, make, folder, out, checkpoint)
    half = silences(spark, out)
    assert [x for x in half if x[1] == "resolved"] == quiet(rows[:200], by, 25 * MINUTE, max(r[2] for r in rows[:200]) - 30 * MINUTE)
    files(spark, rows[200:], folder, 3, disorder=5)
    run(spark, make, folder, out, checkpoint)
    watermark = max(r[2] for r in rows) - 30 * MINUTE
    got = silences(spark, out)
    resolved = [x for x in got if x[1] == "resolved"]
    assert resolved == quiet(rows, by, 25 * MINUTE, watermark) and len(resolved) > 5 and len(got) == len(set(got))
    if by is None:
        batch = telemetry.alert_silence(spark.createDataFrame(rows, SCHEMA), 15 * MINUTE, 10 * MINUTE).where(F.col("resolved_at") <= F.lit(watermark)).collect()
        assert sorted((r.firing_since, r.resolved_at) for r in batch) == [x[2:] for x in resolved]


def test_a_silence_fires_while_it_lasts(spark, tmp_path):
    """A key without further events is brought up by other keys' events, or by a clock."""
    rows = [(1, "a", T0, 0, 0.5, 200), (2, "b", T0, 0, 0.5, 200), *[(10 + i, "b", T0 + i * 5 * MINUTE, 0, 0.5, 200) for i in range(1, 40)]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, rows, folder, 4)
    run(spark, lambda s: alerts.stream_silence(s, "model", lateness="10 minutes"), folder, out, str(tmp_path / "cp"))
    assert silences(spark, out) == [("a", "firing", T0 + 45 * MINUTE, None)]
    ticks, alone, out = str(tmp_path / "ticks"), str(tmp_path / "alone"), str(tmp_path / "out2")
    files(spark, rows[:2], alone, 1)
    files(spark, rows[2:], ticks, 2)
    clocked = alerts.stream_silence(stream_of(spark, alone), None, lateness="10 minutes", clock=stream_of(spark, ticks).select("ts"))
    runner.finish(runner.start_append(clocked, out, str(tmp_path / "cp2")))
    assert silences(spark, out) == [("all", "firing", T0 + 45 * MINUTE, None)]


@pytest.mark.parametrize("by", [None, "model"])
def test_held_alerts_equal_the_batch_and_survive_a_restart(spark, tmp_path, by):
    rows = events(5, 600, pause=0.01)
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    bad = F.col("status").between(500, 599)
    make = lambda s: alerts.stream_held(s, bad, 0.3, 6 * MINUTE, 2 * MINUTE, 6 * MINUTE, by, lateness="10 minutes")
    for part in (rows[:250], rows[250:]):
        files(spark, part, folder, 3, disorder=4)
        run(spark, make, folder, out, checkpoint)
    watermark = max(r[2] for r in rows) - 10 * MINUTE
    got = spark.read.parquet(out).collect()
    table = spark.createDataFrame(rows, SCHEMA)
    for key in ({"all"} if by is None else {"a", "b", ""}):
        mine = table if by is None else table.where(F.coalesce("model", F.lit("")) == key)
        expected = telemetry.alert_error_rate(mine, 6 * MINUTE, 2 * MINUTE, 6 * MINUTE, 0.3).collect()
        closed = sorted((r.pending_since, r.firing_since, r.resolved_after, r.n_evaluations) for r in expected if r.resolved_after + 2 * MINUTE <= watermark)
        here = [r for r in got if r.key == key]
        assert sorted((r.pending_since, r.firing_since, r.resolved_after, r.n_evaluations) for r in here if r.status == "resolved") == closed and closed
        # Every alert that is over was reported while it lasted.
        fired = [r.pending_since for r in here if r.status == "firing"]
        assert len(fired) == len(set(fired)) and {c[0] for c in closed} <= set(fired)


def test_alerts_of_odd_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    files(spark, [(1, None, None, 0, 0.5, None), (2, "a", None, 0, 0.5, 200), (3, None, T0, 0, 0.5, None), (3, None, T0, 0, 0.5, None)], folder, 1)
    run(spark, lambda s: alerts.stream_silence(s, "model"), folder, str(tmp_path / "o1"), str(tmp_path / "c1"))
    run(spark, lambda s: alerts.stream_held(s, F.col("status") >= 500, 0.1, MINUTE, MINUTE, MINUTE), folder, str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert silences(spark, str(tmp_path / "o1")) == [] and spark.read.parquet(str(tmp_path / "o2")).count() == 0
    with pytest.raises(ValueError):
        alerts.stream_held(stream_of(spark, folder), F.lit(True), 0.1, 3 * MINUTE, 2 * MINUTE, MINUTE)


def latest(spark, out):
    table = spark.read.parquet(out)
    return table.groupBy("model").agg(F.max_by(F.struct(*[c for c in table.columns if c not in ("model", "batch")]), "batch").alias("s")).select("model", "s.*")


def assert_same(got, expected):
    got, expected = ({r.model: r.asDict() for r in rows} for rows in (got, expected))
    assert got.keys() == expected.keys()
    for model, row in expected.items():
        for c, v in row.items():
            assert got[model][c] == v or abs(got[model][c] - v) < 1e-12, (model, c)


def test_live_statistics_are_those_of_the_last_n(spark, tmp_path):
    rows = events(7, 500)
    rows += [(1000, "b", None, 1, 0.9, 200), (1001, "c", T0, 1, None, 200), (1002, "c", T0, 0, 0.2, 200), (1002, "c", T0, 0, 0.2, 200)]
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (rows[:220], rows[220:]):
        files(spark, part, folder, 3, disorder=9)
        runner.finish(SM.stream_live_stats(stream_of(spark, folder), out, checkpoint, n=30))
    table = spark.createDataFrame(rows, SCHEMA)
    assert_same(latest(spark, out).collect(), monitor.window_stats(monitor.last_n(table, 30)).collect())
    # A batch has rows of its own models only.
    counts = {r.batch: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert len(counts) == 6 and max(counts.values()) <= 4


def test_live_drift_uses_the_baseline_of_its_batch(spark, tmp_path):
    rows = events(8, 300)
    folder, out, base, checkpoint = (str(tmp_path / x) for x in ("in", "out", "base", "cp"))
    first = monitor.baseline(spark.createDataFrame(rows[:50], SCHEMA).where("model = 'a'"))
    first.write.parquet(base)
    files(spark, rows[:150], folder, 2)
    make = lambda: SM.stream_drift(stream_of(spark, folder), base, out, checkpoint, z_limit=0.05, rate_limit=0.02, n=40)
    runner.finish(make())
    stats = monitor.window_stats(monitor.last_n(spark.createDataFrame(rows[:150], SCHEMA), 40))
    assert_same(latest(spark, out).drop("newest").collect(), monitor.drift(stats, first, 0.05, 0.02).where("status <> 'No predictions recorded' AND model IS NOT NULL").collect())
    second = monitor.baseline(spark.createDataFrame(rows[:100], SCHEMA).where("model IS NOT NULL"))
    second.write.mode("overwrite").parquet(base)
    files(spark, rows[150:], folder, 2)
    runner.finish(make())
    stats = monitor.window_stats(monitor.last_n(spark.createDataFrame(rows, SCHEMA), 40))
    assert_same(latest(spark, out).drop("newest").collect(), monitor.drift(stats, second, 0.05, 0.02).where("model IS NOT NULL").collect())
    assert spark.read.parquet(out).where("drift_detected").count() > 0
