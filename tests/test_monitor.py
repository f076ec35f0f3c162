from datetime import datetime, timedelta

import pytest

from clinrisk.operators import eventlog
from clinrisk.operators import monitor as M

T0 = datetime(2024, 1, 1, 12)
SCHEMA = "request_id bigint, model string, ts timestamp_ntz, prediction int, probability double"


def events(spark, rows, model="lr"):
    return spark.createDataFrame([(i, model, t, y, p) for i, (t, y, p) in enumerate(rows)], SCHEMA)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_statistics(spark):
    row = M.window_stats(events(spark, [(T0, 1, .8), (T0, 0, .2), (T0, 1, .6), (T0, 0, .4)])).first()
    assert row["total_predictions"] == 4 and row["positive_rate"] == 0.5 and row["mean_probability"] == pytest.approx(0.5)
    assert row["min_probability"] == .2 and row["max_probability"] == .8
    assert row["std_probability"] == pytest.approx(0.2236067977)
    assert (row["high_risk_count"], row["medium_risk_count"], row["low_risk_count"]) == (1, 2, 1)
    assert M.window_stats(events(spark, [])).count() == 0


def test_window_holds_the_last_n(spark):
    df = events(spark, [(at(i), 0, i / 10) for i in range(5)])
    assert sorted(r["probability"] for r in M.last_n(df, 3).collect()) == [.2, .3, .4]


def drift_of(spark, base, rows):
    table = spark.createDataFrame([("lr", *base)], "model string, baseline_mean_prob double, baseline_std_prob double, baseline_positive_rate double")
    return M.drift(M.window_stats(events(spark, rows)), table).first()


def test_drift(spark):
    calm = drift_of(spark, (.5, .2, .5), [(T0, 1, .55), (T0, 0, .45)] * 10)
    assert calm["drift_detected"] is False and calm["recommendation"] == M.NO_ACTION
    high = drift_of(spark, (.3, .1, .3), [(T0, 1, .9)] * 10)
    assert high["drift_detected"] and high["probability_drift_zscore"] == pytest.approx(6.0)
    assert high["positive_rate_drift"] == pytest.approx(.7) and high["recommendation"] == M.RETRAIN
    flat = drift_of(spark, (.3, 0.0, None), [(T0, 0, .9)] * 10)
    assert flat["probability_drift_zscore"] == 0.0 and flat["drift_detected"] is False
    assert drift_of(spark, (.5, .2, .5), [])["status"] == M.NO_PREDICTIONS


def test_no_baseline_is_a_status(spark):
    empty = spark.createDataFrame([], "model string, baseline_mean_prob double, baseline_std_prob double, baseline_positive_rate double")
    row = M.drift(M.window_stats(events(spark, [(T0, 1, .8)])), empty).first()
    assert row["status"] == M.NO_BASELINE and row["drift_detected"] is None


def test_drift_events(spark):
    table = spark.createDataFrame([("lr", .3, .1, .3)], "model string, baseline_mean_prob double, baseline_std_prob double, baseline_positive_rate double")
    found = eventlog.drift_events(M.drift(M.window_stats(events(spark, [(T0, 1, .9)] * 3)), table)).collect()
    assert {(r["drift_type"], r["drift_value"], r["threshold"]) for r in found} == {("probability", 6.0, 2.0), ("positive_rate", 0.7, 0.1)}


def test_recent_summary(spark):
    df = events(spark, [(at(-120), 0, .2), (at(0), 1, .8), (at(0), 1, .75)])
    row = M.recent_summary(df, at(0), 60).first()
    assert row["prediction_count"] == 2 and row["high_risk_count"] == 2 and row["positive_rate"] == 1.0 and row["status"] == "ok"
    assert M.recent_summary(df, at(-60), 60).first()["prediction_count"] == 3  # the bound itself is included
    assert M.recent_summary(df, at(600), 60).first()["status"] == "No predictions in last 60 minutes"


def test_baseline_and_reset(spark):
    df = events(spark, [(at(i), i % 2, .5) for i in range(4)])
    assert tuple(M.baseline(df).first()) == ("lr", .5, 0.0, .5)
    assert M.after_reset(df, at(2)).count() == 2


def test_recent_filter_reaches_the_scan(spark, sf):
    from clinrisk.sources import derived

    plan = M.recent_filter(derived.predictions(spark, sf), "2024-01-20 12:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan
