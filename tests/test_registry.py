from datetime import datetime

import pytest

from clinrisk.operators import registry as R
from clinrisk.operators.prep import PrepParams, PrepSpec
from clinrisk.operators.train import LinearModel
from clinrisk.scratch import scratch_path

MODEL = LinearModel(["f_a"], [0.25], -1.0)
PREP = PrepParams(PrepSpec(["a"], [], [], "standard"), {"a": 1.0}, {"a": 2.0}, {})


def table(spark, pairs):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(m, v, t, f"{m}/{v}", {"accuracy": 0.5}, {}) for m, v in pairs], R.VERSION_SCHEMA)


def test_versions_are_compared_as_numbers(spark):
    df = table(spark, [("lr", "1.0.0"), ("lr", "1.0.9"), ("lr", "1.0.10"), ("rf", "1.0.0")])
    assert {(r["model"], r["version"]) for r in R.latest_versions(df).collect()} == {("lr", "1.0.10"), ("rf", "1.0.0")}
    assert {r["next"] for r in R.next_versions(df).collect()} == {"1.0.11", "1.0.1"}
    assert [r["version"] for r in R.list_versions(df, "lr").collect()] == ["1.0.0", "1.0.9", "1.0.10"]
    assert R.model_history(df).count() == 4
    assert R.model_info(df).where("model = 'lr'").first()["threshold"] == 0.5


def test_register_load_and_persist(spark):
    path = scratch_path(spark, "registry")
    models = R.ModelRegistry(spark, path)
    assert models.models() == [] and models.list_versions("lr") == []
    made = [models.register(MODEL, PREP, {"accuracy": 0.1 * i}, {"model_name": "lr", "tuned": False}) for i in range(3)]
    assert made == ["1.0.0", "1.0.1", "1.0.2"]
    assert models.register(MODEL, PREP, {}, {}) == "1.0.0"
    again = R.ModelRegistry(spark, path)
    assert again.models() == ["lr", "unknown"] and again.list_versions("lr") == made
    assert again.load("lr") == (MODEL, PREP) and again.load("lr", "1.0.0") == (MODEL, PREP)
    info = again.info("lr")
    assert info["version"] == "1.0.2" and info["metrics"]["accuracy"] == pytest.approx(0.2) and info["metadata"]["tuned"] == "false"


def test_unknown_model_or_version(spark):
    models = R.ModelRegistry(spark, scratch_path(spark, "registry"))
    models.register(MODEL, PREP, {}, {"model_name": "lr"})
    for args in (("none",), ("lr", "9.9.9")):
        with pytest.raises(ValueError, match="Model not found"):
            models.load(*args)
