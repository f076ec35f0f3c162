from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinrisk.operators import eventlog
from clinrisk.operators import telemetry as T

T0 = datetime(2024, 1, 1)
MINUTE = timedelta(minutes=1)


def requests(spark, rows):
    return spark.createDataFrame(
        [(T0 + timedelta(seconds=s), status, latency, p) for s, status, latency, p in rows],
        "ts timestamp_ntz, status int, latency_s double, probability double").repartition(3)


def random_requests(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(float(s), int(rng.choice([200, 500], p=[.9, .1])), float(l), float(p)) for s, l, p in
            zip(np.sort(rng.integers(0, 3600, n)), rng.random(n) * 1.5, rng.random(n))]
    return rows, requests(spark, rows)


def test_histogram_is_cumulative(spark):
    df = requests(spark, [(0, 200, l, .5) for l in (.01, .02, .3, 2.0)])
    assert {r["le"]: r["n"] for r in T.latency_histogram(df).collect()} == {
        "0.01": 1, "0.025": 2, "0.05": 2, "0.1": 2, "0.25": 2, "0.5": 3, "1.0": 3, "+Inf": 4}
    assert T.slow_requests(df).count() == 1


def test_sliding_windows_equal_direct_counting(spark):
    rows, df = random_requests(spark)
    got = {r["window_end"]: r["n"] for r in T.windowed(df, {"n": (F.count(F.lit(1)), "sum")}, 5 * MINUTE, MINUTE).collect()}
    for end in (T0 + i * MINUTE for i in range(1, 65)):
        expected = sum(end - 5 * MINUTE <= T0 + timedelta(seconds=s) < end for s, *_ in rows)
        assert got.get(end, 0) == expected
    with pytest.raises(ValueError, match="multiple"):
        T.windowed(df, {}, 5 * MINUTE, 2 * MINUTE)


def test_rates(spark):
    df = requests(spark, [(s, 200, .1, .9) for s in range(0, 120, 10)])
    rows = T.rates(T.with_risk_level(df), ["risk_level"], 2 * MINUTE).collect()
    assert [(r["risk_level"], r["n"], r["rate"]) for r in rows] == [("high", 12, 6.0)]


def test_histogram_quantile_interpolation(spark):
    df = requests(spark, [(0, 200, l, .5) for l in [.02] * 5 + [.3] * 4 + [5.0]])
    row = T.latency_quantiles(df, (0.25, 0.8, 0.95)).first()
    assert row["q25"] == pytest.approx(.01 + .015 * 2.5 / 5) and row["q80"] == pytest.approx(.25 + .25 * 3 / 4)
    assert row["q95"] == 1.0


@pytest.mark.parametrize("limit", [0.2, 0.75, 1.2, 1.42])
def test_exact_quantile_alert_decision(spark, limit):
    rows, df = random_requests(spark, 150, seed=1)
    for r in T.quantile_exceeds(df, 0.95, limit, 5 * MINUTE, MINUTE).collect():
        values = [l for s, _, l, _ in rows if r["window_start"] <= T0 + timedelta(seconds=s) < r["window_end"]]
        assert r["n"] == len(values) and r["breach"] == bool(np.quantile(values, 0.95) > limit)


def test_quantile_alert_between_two_values(spark):
    # The quantile lies between 0.9 and 1.1, so it can be on either side of the limit.
    df = requests(spark, [(0, 200, l, .5) for l in (.9, 1.1)])
    for q, breach in ((0.4, False), (0.6, True)):
        assert T.quantile_exceeds(df, q, 1.0, MINUTE).first()["breach"] == breach


def test_alert_must_hold(spark):
    bad = [(60 * m + 30, 500 if m in (3, 4, 5, 6, 9) else 200, .1, .9) for m in range(12)]
    df = requests(spark, bad)
    periods = T.alert_error_rate(df, MINUTE, MINUTE, 3 * MINUTE).collect()
    assert [(r["pending_since"], r["firing_since"], r["resolved_after"], r["n_evaluations"]) for r in periods] == [
        (T0 + 4 * MINUTE, T0 + 7 * MINUTE, T0 + 7 * MINUTE, 4)]
    assert len(T.alert_error_rate(df, MINUTE, MINUTE, timedelta(0)).collect()) == 2
    risky = T.alert_high_risk(df, MINUTE, MINUTE, 10 * MINUTE).collect()
    assert len(risky) == 1 and risky[0]["n_evaluations"] == 12
    assert T.alert_latency(df).count() == 0


def test_a_missing_window_ends_an_alert(spark):
    df = requests(spark, [(60 * m, 500, .1, .5) for m in (0, 1, 2, 6, 7)])
    periods = T.alert_error_rate(df, MINUTE, MINUTE, MINUTE).orderBy("pending_since").collect()
    assert [r["n_evaluations"] for r in periods] == [3, 2]


def test_gaps_equal_sorting(spark):
    rng = np.random.default_rng(2)
    times = np.cumsum(rng.exponential(40, 500))
    df = requests(spark, [(float(round(s, 6)), 200, .1, .5) for s in times]).withColumn("instance", F.lit("a"))
    ordered = sorted(r["ts"] for r in df.collect())
    expected = {(a, b) for a, b in zip(ordered, ordered[1:]) if b - a > MINUTE}
    assert {(r["last_seen"], r["next_seen"]) for r in T.gaps(df, MINUTE).collect()} == expected
    assert T.heartbeat_gaps(df).count() == len(expected) > 20
    silent = T.alert_silence(df, MINUTE, MINUTE).collect()
    assert {r["resolved_at"] for r in silent} == {b for a, b in expected if b - a > 2 * MINUTE}


def test_log_records(spark):
    import json

    df = spark.createDataFrame([(T0, 7, 1, 0.73456, 0.0123456, 3, "eu")],
                               "ts timestamp_ntz, patient_id bigint, prediction int, probability double, latency_s double, batch_id bigint, site string")
    event = eventlog.prediction_events(df, ["site"]).first().asDict()
    assert (event["probability"], event["latency_ms"], event["risk_level"], event["site"]) == (0.7346, 12.35, "high", "eu")
    line = json.loads(eventlog.to_log_lines(eventlog.prediction_events(df), "Prediction made").first()["value"])
    assert list(line)[:4] == ["timestamp", "level", "logger", "message"] and line["timestamp"] == "2024-01-01T00:00:00.000000Z"
    assert line["event_type"] == "prediction" and line["prediction_label"] == "heart_disease"
    batch = eventlog.batch_events(df).first()
    assert (batch["batch_size"], batch["high_risk_count"], batch["high_risk_rate"], batch["avg_latency_ms"]) == (1, 1, 1.0, 12.35)
