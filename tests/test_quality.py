import numpy as np
from pyspark.sql import functions as F

from clinrisk.operators import quality
from clinrisk.schema import PATIENT_SCHEMA, REQUEST_RULES, Rule
from tests.test_sources import ROWS

VALID = {"age": 55, "sex": 1, "cp": 0, "trestbps": 140, "chol": 250, "fbs": 0, "restecg": 1, "thalach": 150, "exang": 0,
         "oldpeak": 1.5, "slope": 1, "ca": 0, "thal": 2}
REQUEST = ", ".join(f"{c} {'double' if c == 'oldpeak' else 'int'}" for c in VALID)


def test_missing_values_and_drop(spark):
    df = spark.createDataFrame([*ROWS, (None, *ROWS[0][1:])], PATIENT_SCHEMA)
    assert [tuple(r) for r in quality.missing_values(df).collect()] == [("age", 1)]
    clean = quality.drop_missing(df)
    assert clean.count() == 3 and quality.range_violations(clean).count() == 0


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]] + [(None,)], "value double")
    marked = quality.detect_outliers(df, ["value", "absent"]).collect()
    assert [r["value"] for r in marked if r["value_outlier"]] == [100.0]
    assert not any(r["absent_outlier"] for r in marked)
    assert quality.outlier_bounds(df, ["value"], "iqr", 1.5)["value"] == (-1.5, 8.5)
    assert tuple(quality.outlier_rows(df, ["value"]).first()) == (7, 1)


def test_zscore_uses_sample_deviation_and_constant_has_no_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 30.0]
    z = np.abs((np.array(values) - np.mean(values)) / np.std(values, ddof=1))
    df = spark.createDataFrame([(v, 5.0) for v in values], "value double, same double")
    rows = quality.detect_outliers(df, ["value", "same"], "zscore", 1.7).collect()
    assert [r["value_outlier"] for r in sorted(rows)] == list(z > 1.7)
    assert not any(r["same_outlier"] for r in rows)


def test_range_rules(spark):
    rules = [Rule("age", min=0, max=120), Rule("sex", values=(0, 1)), Rule("absent", min=0)]
    df = spark.createDataFrame([(-5, 2), (130, None), (None, 1)], "age int, sex int")
    rows = {(r["column"], r["rule"]): r["n_violations"] for r in quality.range_violations(df, rules).collect()}
    assert rows == {("age", "min"): 1, ("age", "max"): 1, ("sex", "values"): 2}
    assert {(r["value"], r["n"]) for r in quality.bad_values(df, rules).collect()} == {("2", 1), (None, 1)}
    texts = {r["message"] for r in quality.violation_messages(df, rules).collect()}
    assert "age: 1 values below minimum 0" in texts and "sex: 2 invalid values, expected [0, 1]" in texts


def test_request_validation(spark):
    cases = [{}, {"age": None}, {"age": 150}, {"sex": 2}, {"age": 0}, {"cp": 5}, {"trestbps": 79, "chol": 601}]
    df = spark.createDataFrame([tuple({**VALID, **c}.values()) + (i,) for i, c in enumerate(cases)], REQUEST + ", id int")
    rows = {r["id"]: r for r in quality.validate_requests(df).collect()}
    assert rows[0]["accepted"] and not any(rows[i]["accepted"] for i in range(1, 7))
    assert rows[1]["errors"] == ["age: field required"] and rows[4]["errors"] == ["age: must be at least 1"]
    assert rows[6]["errors"] == ["trestbps: must be at least 80", "chol: must be at most 600"]
    assert len(REQUEST_RULES) == 13


def test_batch_limits(spark):
    df = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in (0, 1, 100, 101)])).alias("n")).select(
        "n", F.slice(F.array_repeat(F.lit(1), 101), 1, F.col("n")).alias("patients"))
    got = {r["n_patients"]: r["accepted"] for r in quality.validate_batches(df).collect()}
    assert got == {0: False, 1: True, 100: True, 101: False}
    assert quality.validate_batches(df, None).where("accepted").count() == 3
