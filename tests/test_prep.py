import pytest

from clinrisk.operators import prep
from clinrisk.scratch import scratch_path


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("kind, expected", [
    ("standard", [-1.0, -1.0, 0.0, 0.0, 2.0]), ("robust", [-1.0, -1.0, 0.0, 0.0, 2.0]), ("minmax", [0.0, 0.0, 1 / 3, 1 / 3, 1.0])])
def test_scalers(spark, kind, expected):
    # mean 0, population variance 6/5 for the standard case is checked against the formula below
    values = [1, 1, 2, 2, 4]
    df = spark.createDataFrame([(i, v, 5) for i, v in enumerate(values)], "i int, v int, same int")
    got = column(prep.scale_columns(df, ["v", "same"], kind), "v_scaled")
    if kind == "standard":
        mean = sum(values) / 5
        std = (sum((v - mean) ** 2 for v in values) / 5) ** 0.5
        expected = [(v - mean) / std for v in values]
    assert got == pytest.approx(expected)
    assert column(prep.scale_columns(df, ["v", "same"], kind), "same_scaled") == [0.0] * 5
    with pytest.raises(ValueError, match="Unknown scaler"):
        prep.scale_columns(df, ["v"], "other")


def test_robust_scaler_interpolates(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    assert prep.fit_scaler(df, ["v"], "robust") == ({"v": 3.5}, {"v": 2.5})


def test_onehot_drops_first_sorted_category_and_ignores_unseen(spark):
    fit = spark.createDataFrame([(3,), (1,), (2,), (None,)], "c int")
    params = prep.fit_prep(fit, prep.PrepSpec([], [], ["c"]))
    assert params.categories == {"c": [1, 2, 3, None]}
    new = spark.createDataFrame([(0, 1), (1, 2), (2, 9), (3, None)], "i int, c int")
    rows = [tuple(r)[1:] for r in prep.transform(new, params, ["i"]).orderBy("i").collect()]
    assert params.feature_names() == ["f_c_2", "f_c_3", "f_c_null"]
    assert rows == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]


def test_too_many_categories(spark):
    with pytest.raises(ValueError, match="categories"):
        prep.fit_categories(spark.range(50).withColumnRenamed("id", "c"), ["c"], max_categories=10)


def test_model_space_has_27_features_in_order(spark, sf):
    from clinrisk.functions.features import engineer_features
    from clinrisk.sources import derived

    df = engineer_features(derived.patients(spark, sf))
    params, x = prep.fit_transform(df, prep.model_spec(df.columns), ["patient_id"])
    assert len(params.feature_names()) == 27 and x.columns == ["patient_id", *params.feature_names()]
    assert x.columns[1:7] == ["f_age", "f_trestbps", "f_chol", "f_thalach", "f_oldpeak", "f_heart_rate_reserve"]
    assert x.columns[11:15] == ["f_sex", "f_fbs", "f_exang", "f_cp_1"]


def test_parameters_survive_storage(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, 1, None), (4, 1, 10)], "a int, b int, c int")
    params = prep.fit_prep(df, prep.PrepSpec(["a"], ["b"], ["c"], "minmax"))
    path = scratch_path(spark, "prep")
    prep.save_prep(params, spark, path)
    assert prep.load_prep(spark, path) == params


def test_missing_feature_column(spark):
    with pytest.raises(ValueError, match="Missing columns"):
        prep.fit_prep(spark.range(3), prep.PrepSpec(["a"], [], []))


def test_categories_keep_their_type(spark):
    df = spark.createDataFrame([("b", 1.2, True), ("a", 1.8, None), (None, 1.2, False)], "s string, d double, b boolean")
    params = prep.fit_prep(df, prep.PrepSpec([], [], ["s", "d", "b"]))
    assert params.categories == {"s": ["a", "b", None], "d": [1.2, 1.8], "b": [False, True, None]}
    assert params.feature_names() == ["f_s_b", "f_s_null", "f_d_1.8", "f_b_True", "f_b_null"]
    rows = {tuple(r) for r in prep.transform(df, params).collect()}
    assert rows == {(1.0, 0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0, 0.0)}
    path = scratch_path(spark, "prep")
    prep.save_prep(params, spark, path)
    assert prep.load_prep(spark, path) == params
    with pytest.raises(ValueError, match="not supported"):
        prep.fit_categories(spark.sql("SELECT DATE'2024-01-01' AS t"), ["t"])


@pytest.mark.parametrize("scaler", prep.SCALERS)
def test_a_column_without_values_is_named(spark, scaler):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, empty int")
    with pytest.raises(ValueError, match="empty"):
        prep.fit_scaler(df, ["a", "empty"], scaler)
