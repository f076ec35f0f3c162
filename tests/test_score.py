import json
import math

import pytest
from pyspark.sql import functions as F

from clinrisk.functions.features import engineer_features
from clinrisk.operators import prep, score, train
from clinrisk.operators.registry import ModelRegistry
from clinrisk.plans.scoring import score as score_job
from clinrisk.scratch import scratch_path
from clinrisk.sources import derived
from tests.test_quality import REQUEST, VALID


@pytest.fixture(scope="module")
def scorer(spark, sf):
    df = engineer_features(derived.patients(spark, sf))
    params = prep.fit_prep(df, prep.model_spec(df.columns))
    names = params.feature_names()
    return score.Scorer(params, train.LinearModel(names, [((i * 7) % 5 - 2) / 4 for i in range(len(names))], 0.1))


def by_hand(scorer, patient):
    """Probability of one patient with plain Python arithmetic."""
    x = dict(patient)
    x["heart_rate_reserve"] = 220 - x["age"] - x["thalach"]
    x["cardiac_risk_score"] = sum(w for ok, w in [
        (x["age"] > 55, 1), (x["sex"] == 1, 1), (x["cp"] == 0, 2), (x["trestbps"] >= 140, 1), (x["chol"] >= 240, 1),
        (x["fbs"] == 1, 1), (x["exang"] == 1, 2), (x["oldpeak"] > 2, 2), (x["ca"] > 0, 2)] if ok)
    for a, b in (("age", "thalach"), ("oldpeak", "slope"), ("cp", "exang")):
        x[f"{a}_x_{b}"] = x[a] * x[b]
    p, margin = scorer.prep, scorer.model.intercept
    values = {f"f_{c}": (x[c] - p.center[c]) / p.scale[c] for c in p.spec.continuous}
    values |= {f"f_{c}": x[c] for c in p.spec.binary}
    values |= {f"f_{c}_{v}": float(x[c] == v) for c in p.spec.categorical for v in p.categories[c][1:]}
    margin += sum(b * values[f] for f, b in zip(scorer.model.features, scorer.model.coefficients))
    return 1 / (1 + math.exp(-margin))


def request(spark, *patients):
    return spark.createDataFrame([tuple({**VALID, **p}.values()) for p in patients], REQUEST)


def test_table_scoring_keeps_columns_and_domains(spark, sf, scorer):
    df = derived.patients(spark, sf)
    out = score.score_table(df, scorer)
    assert out.columns == [*df.columns, "probability", "prediction", "prediction_label", "risk_level"]
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r["probability"] <= 1 for r in rows)
    assert all((r["prediction"] == 1) == (r["probability"] >= 0.5) for r in rows)
    assert rows[0]["probability"] == pytest.approx(by_hand(scorer, rows[0].asDict()))
    share = score.positive_share(out).first()
    assert share["n_positive"] == sum(r["prediction"] for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_scoring_reuses_engineered_columns_and_reports_missing_inputs(spark, scorer):
    raw = request(spark, {})
    full = score.score_service(engineer_features(raw), scorer).first()
    assert full == score.score_service(raw, scorer).first()
    with pytest.raises(ValueError, match="Missing columns"):
        score.score_service(raw.drop("chol"), scorer)


def test_service_response(spark, scorer):
    row = score.score_service(request(spark, {}), scorer).first()
    p = by_hand(scorer, VALID)
    assert row["probability"] == pytest.approx(p)
    assert row["confidence"] == pytest.approx(max(p, 1 - p)) and row["threshold_used"] == 0.5
    assert row["risk_level"] in ("low", "medium", "high")


def test_request_batches_isolate_bad_rows(spark, scorer):
    df = request(spark, {}, {"age": 150}, {"thal": None}, {"age": 70}).select(F.struct("*").alias("p"))
    one = df.agg(F.collect_list("p").alias("patients"))
    empty = one.select(F.filter("patients", lambda p: p["age"] < 0).alias("patients"))
    large = one.select(F.flatten(F.array_repeat("patients", 26)).alias("patients"))
    rows = score.score_requests(one.unionByName(empty).unionByName(large), scorer).collect()
    first = next(r for r in rows if r["n_patients"] == 4)
    assert [p["prediction"] for p in first["predictions"]].count(-1) == 2 and first["total_count"] == 4
    for p in first["predictions"]:
        if p["prediction"] == -1:
            assert (p["prediction_label"], p["probability"], p["risk_level"], p["confidence"], p["threshold_used"]) == ("error", 0, "low", 0, 0.5)
            assert len(p["errors"]) == 1
    good = [p["probability"] for p in first["predictions"] if p["prediction"] != -1]
    assert sorted(good) == pytest.approx(sorted([by_hand(scorer, VALID), by_hand(scorer, {**VALID, "age": 70})]))
    assert first["high_risk_count"] == sum(p >= 0.7 for p in good)
    rejected = [r for r in rows if r["n_patients"] in (0, 104)]
    assert len(rejected) == 2 and all(not r["accepted"] and r["predictions"] is None and r["total_count"] is None for r in rejected)
    assert score.score_requests(large, scorer, limit=None).first()["total_count"] == 104


def test_payload_status_codes(spark, scorer):
    bodies = [json.dumps(VALID), "{bad", json.dumps({k: v for k, v in VALID.items() if k not in ("age", "thal")}),
              json.dumps({**VALID, "chol": None}), json.dumps({**VALID, "thal": None}), json.dumps({**VALID, "sex": "x"})]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = {r["id"]: r for r in score.score_payloads(df, scorer).collect()}
    assert [rows[i]["status"] for i in range(6)] == [200, 400, 400, 500, 200, 500]
    assert rows[2]["details"] == ["Missing required field: age", "Missing required field: thal"]
    answer = json.loads(rows[0]["response"])
    assert answer["probability"] == pytest.approx(by_hand(scorer, VALID), abs=5e-5)
    assert list(answer) == ["prediction", "prediction_label", "probability", "risk_level", "confidence", "threshold_used"]
    assert json.loads(rows[1]["response"])["error"] == "Invalid JSON" and rows[3]["probability"] is None


def test_scored_domain_rule(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (-1, 0.0, 0.0), (2, 0.5, 0.5), (1, 1.2, 0.5), (1, None, 0.5)],
                               "prediction int, probability double, confidence double")
    assert [r["valid"] for r in score.scored_violations(df).collect()] == [True, True, False, False, False]


def test_scoring_jobs_with_a_registered_model(spark, sf, scorer):
    models = ModelRegistry(spark, scratch_path(spark, "registry"))
    models.register(scorer.model, scorer.prep, {"accuracy": 0.8}, {"model_name": "lr", "threshold": 0.9})
    df = derived.patients(spark, sf)
    plain = score_job(df, models, "lr").agg(F.sum("prediction")).first()[0]
    strict = score_job(df, models, "lr", use_registered_threshold=True).agg(F.sum("prediction")).first()[0]
    assert strict < plain
    assert score_job(derived.payloads(spark, sf), models, "lr", kind="payloads").where("status = 200").count() > 0
    assert score_job(derived.batch_requests(spark, sf), models, "lr", kind="requests").where("accepted").count() > 0
    assert "confidence" in score_job(df, models, "lr", kind="service").columns
    with pytest.raises(ValueError):
        score_job(df, models, "lr", kind="other")
