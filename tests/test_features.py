import pytest
from pyspark.sql import functions as F

from clinrisk.functions import features as X
from clinrisk.functions import scoring as S


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_bins(spark):
    assert one(spark, [25, 45, 60, 75, 0, 40, 41, 55, 70, 120, 121, None], "int", X.age_group) == [
        "young", "middle", "senior", "elderly", None, "young", "middle", "middle", "senior", "elderly", None, None]
    assert one(spark, [110, 125, 135, 150, 120, 130, 140, None], "int", X.bp_category) == [
        "normal", "elevated", "high_stage1", "high_stage2", "elevated", "high_stage1", "high_stage2", "unknown"]
    assert one(spark, [180, 220, 260, 200, 240, None], "int", X.cholesterol_risk) == [
        "desirable", "borderline", "high", "borderline", "high", "unknown"]


def test_heart_rate_reserve_and_st_score(spark):
    df = spark.createDataFrame([(40, 150), (50, 140), (60, 130)], "age int, thalach int")
    assert [r[0] for r in df.select(X.heart_rate_reserve(F.col("age"), F.col("thalach"))).collect()] == [30, 30, 30]
    df = spark.createDataFrame([(2.0, 1)], "oldpeak double, slope int")
    assert df.select(X.st_risk_score(F.col("oldpeak"), F.col("slope"))).first()[0] == 4.0


RISK = "age int, sex int, cp int, trestbps int, chol int, fbs int, exang int, oldpeak double, ca int"


def test_risk_score_range_and_nulls(spark):
    rows = [(60, 1, 0, 150, 260, 0, 1, 3.0, 2), (40, 0, 1, 120, 180, 0, 0, 1.0, 0), (70, 1, 0, 140, 240, 1, 1, 2.5, 1),
            (None,) * 9]
    df = spark.createDataFrame(rows, RISK)
    assert [r[0] for r in df.select(X.cardiac_risk_score(F.col)).collect()] == [12, 0, 13, 0]


def test_engineering_flags_and_guards(spark):
    df = spark.createDataFrame([(50, 150, 1.0, 1)], "age int, thalach int, oldpeak double, slope int")
    out = X.engineer_features(df)
    assert out.columns == ["age", "thalach", "oldpeak", "slope", "age_group", "heart_rate_reserve", "age_x_thalach",
                           "oldpeak_x_slope"]
    row = out.first()
    assert row["age_x_thalach"] == 7500 and row["oldpeak_x_slope"] == 1.0
    assert X.engineer_features(df, age_groups=False, reserve=False, interactions=False).columns == df.columns
    assert X.add_interactions(df, [("age", "slope"), ("age", "gone")]).columns[-1] == "age_x_slope"


def test_risk_levels_and_confidence(spark):
    p = [0.0, 0.29, 0.3, 0.31, 0.69, 0.7, 0.71, 1.0, None]
    assert one(spark, p, "double", S.risk_level) == ["low", "low", "medium", "medium", "medium", "high", "high", "high", None]
    assert one(spark, p, "double", lambda c: S.risk_level(c, "right")) == [
        None, "low", "low", "medium", "medium", "medium", "high", "high", None]
    assert one(spark, [0.5, 0.4], "double", lambda c: S.prediction(c)) == [1, 0]
    assert one(spark, [0.8, 0.4], "double", lambda c: S.confidence(c, S.prediction(c))) == [0.8, 0.6]
    with pytest.raises(ValueError):
        S.risk_level(F.col("v"), "both")


def test_risk_factors(spark):
    df = spark.createDataFrame([(56, 135, 199, 1, 2.1), (55, 140, 240, 0, 1.0)], "age int, trestbps int, chol int, exang int, oldpeak double")
    rows = df.select("age", F.inline(X.risk_factors(F.col))).collect()
    assert [r["level"] for r in rows if r["age"] == 56] == ["red", "amber", "green", "red", "red"]
    assert [r["level"] for r in rows if r["age"] == 55] == ["green", "red", "red", "green", "green"]
    assert rows[1]["detail"] == "BP: 135 mmHg (Stage 1 Hypertension)"


def test_label_dictionaries(spark):
    df = spark.createDataFrame([(3, "Male"), (9, "Robot")], "thal int, sex string")
    assert [r["thal_label"] for r in X.decode_labels(df).collect()] == ["reversible_defect", None]
    assert [r["sex"] for r in X.encode_labels(df.select("sex")).collect()] == [1, None]


def test_feature_projection_is_one_codegen_stage(spark, sf):
    from clinrisk.sources import derived

    plan = X.engineer_features(derived.patients(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "*(1)" in plan and "*(2)" not in plan and "Python" not in plan and "Exchange" not in plan
