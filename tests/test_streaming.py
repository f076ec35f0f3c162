from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clinrisk.operators import monitor
from clinrisk.operators.registry import ModelRegistry
from clinrisk.scratch import scratch_path
from clinrisk.streaming import monitor as SM
from clinrisk.streaming import runner
from clinrisk.streaming import scoring as SS
from clinrisk.streaming import telemetry as ST
from tests.test_quality import REQUEST, VALID
from tests.test_registry import MODEL
from tests.test_score import scorer  # noqa: F401

T0 = datetime(2024, 1, 1)
SCHEMA = "request_id bigint, model string, ts timestamp_ntz, prediction int, probability double"


def rows(n=300):
    return [(i, "hot" if i % 3 else "cold", T0 + timedelta(minutes=i), i % 2, (i * 37 % 101) / 100) for i in range(n)]


@pytest.fixture
def landing(spark, tmp_path):
    """A folder of five files in time order, and the whole table."""
    data = rows()
    for k in range(5):
        spark.createDataFrame(data[60 * k: 60 * (k + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), spark.createDataFrame(data, SCHEMA)


def stream_of(spark, folder):
    return runner.read_table_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, max_files=1)


def test_last_n_over_many_batches_equals_batch(spark, landing):
    folder, table = landing
    state = scratch_path(spark, "state")
    q = runner.finish(SM.stream_last_n(stream_of(spark, folder), state, scratch_path(spark, "cp"), n=25))
    assert q.lastProgress["batchId"] == 4
    got = {r["request_id"] for r in SM.last_state(q, spark, state).collect()}
    assert got == {r["request_id"] for r in monitor.last_n(table, 25).collect()} and len(got) == 50


def test_replayed_batch_does_not_change_the_state(spark, landing):
    folder, table = landing
    state = scratch_path(spark, "state")
    for _ in range(2):  # a new checkpoint replays every batch over the existing state
        q = runner.finish(SM.stream_last_n(stream_of(spark, folder), state, scratch_path(spark, "cp"), n=25))
    got = sorted(r["request_id"] for r in SM.last_state(q, spark, state).collect())
    assert got == sorted(r["request_id"] for r in monitor.last_n(table, 25).collect())


def test_recent_windows_equal_batch_once_closed(spark, landing):
    folder, table = landing
    sentinel = [(10_000, "hot", T0 + timedelta(days=2), 0, .5)]
    spark.createDataFrame(sentinel, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    out = scratch_path(spark, "recent")
    runner.finish(SM.stream_recent(stream_of(spark, folder), out, scratch_path(spark, "cp")))
    got = {(r["window_start"], r["model"]): (r["prediction_count"], round(r["mean_probability"], 9)) for r in spark.read.parquet(out).collect()}
    batch = SM.recent_windows(table).collect()
    assert got == {(r["window_start"], r["model"]): (r["prediction_count"], round(r["mean_probability"], 9)) for r in batch}


def test_late_rows_are_dropped_after_the_watermark(spark, landing):
    folder, _ = landing
    spark.createDataFrame([(10_001, "hot", T0 + timedelta(days=2), 0, .5)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(10_002, "late", T0, 0, .5), (10_003, "hot", T0 + timedelta(days=4), 0, .5)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    out = scratch_path(spark, "recent")
    runner.finish(SM.stream_recent(stream_of(spark, folder), out, scratch_path(spark, "cp")))
    assert spark.read.parquet(out).where("model = 'late'").count() == 0


def test_rates_and_sessions(spark, landing):
    folder, _ = landing
    spark.createDataFrame([(10_000, "hot", T0 + timedelta(days=2), 0, .5)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    out, sessions = scratch_path(spark, "rates"), scratch_path(spark, "sessions")
    runner.finish(runner.start_append(ST.stream_rates(stream_of(spark, folder), ["model"], timedelta(hours=1)), out, scratch_path(spark, "cp")))
    assert spark.read.parquet(out).where("window_start = timestamp'2024-01-01 01:00:00'").agg(F.sum("n")).first()[0] == 60
    quiet = ST.stream_sessions(stream_of(spark, folder), timedelta(minutes=30), ["model"])
    runner.finish(runner.start_append(quiet, sessions, scratch_path(spark, "cp")))
    assert {(r["model"], r["first_seen"], r["last_seen"], r["n"]) for r in spark.read.parquet(sessions).collect()} == {
        ("hot", T0 + timedelta(minutes=1), T0 + timedelta(minutes=299), 200), ("cold", T0, T0 + timedelta(minutes=297), 100)}


def test_scoring_stream_and_reload(spark, scorer, tmp_path):  # noqa: F811
    for k in range(2):
        patients = [(i + 10 * k, *{**VALID, "age": 40 + i}.values()) for i in range(10)]
        spark.createDataFrame(patients, "id int, " + REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder, out = str(tmp_path / "in"), scratch_path(spark, "scores")
    runner.finish(SS.stream_scores(stream_of(spark, folder), scorer, ["id"], out, scratch_path(spark, "cp")))
    from clinrisk.operators.score import score_service
    expected = {r["id"]: r["probability"] for r in score_service(spark.read.parquet(folder), scorer, ["id"]).collect()}
    assert {r["id"]: r["probability"] for r in spark.read.parquet(out).collect()} == expected

    models = ModelRegistry(spark, scratch_path(spark, "registry"))
    models.register(scorer.model, scorer.prep, {}, {"model_name": "lr"})
    reloaded, cp = scratch_path(spark, "reload"), scratch_path(spark, "cp")
    runner.finish(SS.stream_reload(stream_of(spark, folder), models, "lr", ["id"], reloaded, cp))
    models.register(scorer.model, scorer.prep, {}, {"model_name": "lr"})
    spark.createDataFrame([(99, *VALID.values())], "id int, " + REQUEST).coalesce(1).write.mode("append").parquet(folder)
    runner.finish(SS.stream_reload(stream_of(spark, folder), models, "lr", ["id"], reloaded, cp))
    versions = {r["id"]: r["model_version"] for r in spark.read.parquet(reloaded).collect()}
    assert len(versions) == 21 and versions[0] == "1.0.0" and versions[99] == "1.0.1"
    assert MODEL.features == ["f_a"]


def test_a_missing_state_stops_the_stream_and_old_states_go(spark, landing):
    import os

    from pyspark.errors import StreamingQueryException

    folder, _ = landing
    state, cp = scratch_path(spark, "state"), scratch_path(spark, "cp")
    runner.finish(SM.stream_last_n(stream_of(spark, folder), state, cp, n=25))
    assert sorted(os.listdir(state)) == ["batch=3", "batch=4"]
    spark.createDataFrame(rows(10), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(StreamingQueryException):
        runner.finish(SM.stream_last_n(stream_of(spark, folder), scratch_path(spark, "lost"), cp, n=25))
