import pytest

from clinrisk.operators import train
from clinrisk.operators.registry import ModelRegistry
from clinrisk.plans.training import SHORT, TrainConfig
from clinrisk.plans.training import train as run
from clinrisk.scratch import scratch_path
from clinrisk.sources import derived


def test_full_training_registers_a_usable_model(spark, sf):
    models = ModelRegistry(spark, scratch_path(spark, "registry"))
    result = run(derived.patients_raw(spark, sf), TrainConfig(), models)
    assert result.version == "1.0.0" and set(result.quality["missing"]) == {"age", "chol", "thal"}
    assert any(e.startswith("trestbps:") for e in result.quality["errors"]) and result.quality["n_outlier_rows"] > 0
    assert len(result.scorer.model.features) == 27 and 0.1 <= result.scorer.threshold <= 0.9
    row = result.metrics.first()
    assert row["roc_auc"] > 0.6 and row["threshold"] == result.scorer.threshold
    assert models.load("logistic_regression") == (result.scorer.model, result.scorer.prep)
    info = models.info("logistic_regression")
    assert float(info["metadata"]["threshold"]) == result.scorer.threshold and info["metrics"]["roc_auc"] == row["roc_auc"]
    assert result.scores["train_accuracy"] > 0.5


def test_short_and_tuned_jobs(spark, sf):
    df = derived.patients(spark, sf)
    short = run(df, SHORT)
    assert short.scorer.threshold == 0.5 and short.quality == {} and "val_accuracy" not in short.scores
    assert len(short.scorer.model.features) == 5 + 3 + 14
    grid = {"C": [0.1, 1], "penalty": ["l2"], "solver": ["liblinear"], "class_weight": ["balanced"]}
    tuned = run(df, TrainConfig(quality_checks=False, tune=True, cv_folds=3, grid=grid, scaler="robust"))
    assert tuned.best_params in train.grid_points(grid) and tuned.scores["cv_score"] > 0.6


def test_schema_gate(spark, sf):
    with pytest.raises(ValueError, match="Missing columns"):
        run(derived.patients(spark, sf).drop("chol"))
