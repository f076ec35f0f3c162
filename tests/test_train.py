import numpy as np
import pytest
from pyspark.sql import functions as F

from clinrisk.operators import metrics, newton, select, train
from clinrisk.operators.newton import FitTask, fit_many
from clinrisk.operators.select import select_by_rfe
from clinrisk.operators.train import LogisticSpec
from clinrisk.scratch import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 4))
    x[:, 3] = x[:, 0] - x[:, 1]  # collinear
    y = (x[:, 0] + x[:, 1] + rng.normal(size=400) > 0.4).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))],
                               "id bigint, y int, a double, b double, c double, d double")
    return x, y, df.repartition(5).persist()


FEATURES = ["a", "b", "c", "d"]


def objective(x, y, beta, spec):
    w = np.ones(len(y))
    if spec.class_weight == "balanced":
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    m = x @ beta[:-1] + beta[-1]
    loss = (w * np.logaddexp(0, np.where(y == 1, -m, m))).sum()
    b = beta if spec.solver == "liblinear" else beta[:-1]
    return (np.abs(b).sum() if spec.penalty == "l1" else 0.5 * b @ b) + spec.C * loss


@pytest.mark.parametrize("spec", [
    LogisticSpec(1.0, "l2", "liblinear", 200, "balanced"), LogisticSpec(0.01, "l2", "liblinear", 200, None),
    LogisticSpec(100.0, "l2", "lbfgs", 200, None), LogisticSpec(1.0, "l1", "liblinear", 200, "balanced"),
    LogisticSpec(0.02, "l1", "liblinear", 200, None), LogisticSpec(100.0, "l1", "liblinear", 200, None)])
def test_newton_minimises_the_objective_and_agrees_with_spark_ml(data, spec):
    x, y, df = data
    model = train.fit(df, FEATURES, "y", spec)
    beta = np.array([*model.coefficients, model.intercept])
    best = objective(x, y, beta, spec)
    rng = np.random.default_rng(0)
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(200):
            assert objective(x, y, beta + scale * rng.normal(size=5), spec) > best
    matrix = train.training_matrix(df, FEATURES, "y")
    wide, intercept = train.fit_wide(matrix, FEATURES, len(y), int(y.sum()), spec)
    assert objective(x, y, np.array([*wide, intercept]), spec) == pytest.approx(best, rel=1e-5)
    if spec.penalty == "l2":
        np.testing.assert_allclose([*wide, intercept], beta, atol=1e-3)


def test_l1_gives_exact_zeros(data):
    model = train.fit(data[2], FEATURES, "y", LogisticSpec(0.02, "l1", "liblinear"))
    assert 0 < sum(b == 0 for b in model.coefficients) < 4


def test_many_fits_equal_single_fits(data):
    _, y, df = data
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    tasks = [FitTask(c, (1.0, 1.0), l1, fold=f) for c in (0.1, 10.0) for l1 in (False, True) for f in (0, 1, None)]
    together = fit_many(folded, FEATURES, "y", tasks, "fold")
    for task, beta in zip(tasks, together):
        part = folded if task.fold is None else folded.where(F.col("fold") != task.fold)
        alone = fit_many(part, FEATURES, "y", [FitTask(task.c, task.weights, task.l1)])[0]
        np.testing.assert_allclose(beta, alone, atol=1e-4)


def test_models_by_name():
    assert train.get_model("logistic_regression").class_weight == "balanced"
    assert train.get_model("logistic_regression", {}) == LogisticSpec()
    with pytest.raises(ValueError, match="Unknown model"):
        train.get_model("forest")
    with pytest.raises(ValueError):
        LogisticSpec(penalty="l1", solver="lbfgs")
    assert len(train.grid_points(train.PARAM_GRIDS["logistic_regression"])) == 72


def test_training_scores_and_storage(spark, data):
    _, _, df = data
    model, scores = train.train_model(df, FEATURES, "y", train.get_model("logistic_regression"), df)
    assert scores["train_accuracy"] > 0.7 and scores["val_accuracy"] == scores["train_accuracy"]
    assert train.LinearModel.from_table(model.to_table(spark).repartition(3)) == model
    path = scratch_path(spark, "model")
    train.save_model(model, {"threshold": 0.4}, spark, path)
    assert train.load_model(spark, path) == model == train.load_model(spark, f"{path}/model")
    assert spark.read.json(f"{path}/metadata").first()["threshold"] == 0.4
    with pytest.raises(ValueError, match="both classes"):
        train.fit(df.where("y = 1"), FEATURES, "y", LogisticSpec())


def test_grid_search_scores_equal_separate_evaluation(data):
    _, _, df = data
    grid = {"C": [0.01, 1], "penalty": ["l1", "l2"], "solver": ["liblinear"], "max_iter": [100, 200], "class_weight": [None]}
    found = train.grid_search(df, FEATURES, "y", "id", grid=grid, k=3)
    rows = found.cv_results.orderBy("point").collect()
    assert len(rows) == 8 and rows[0]["mean_score"] == rows[2]["mean_score"]
    best = min(r["point"] for r in rows if r["mean_score"] == max(r["mean_score"] for r in rows))
    assert found.best_params == train.grid_points(grid)[best] and rows[best]["rank"] == 1
    folded = train.stratified_folds(df, "id", "y", 3)
    spec = LogisticSpec(1, "l2", "liblinear", 100, None)
    point = next(i for i, p in enumerate(train.grid_points(grid)) if p["C"] == 1 and p["penalty"] == "l2")
    for f in range(3):
        model = train.fit(folded.where(F.col("fold") != f), FEATURES, "y", spec)
        held = folded.where(F.col("fold") == f).withColumn("p", model.probability({c: F.col(c) for c in FEATURES}))
        assert metrics.roc_auc(held, "p", "y").first()[0] == pytest.approx(rows[point]["fold_scores"][f], abs=1e-4)


def test_correlated_features(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=100)
    rows = [(float(v), float(v) + 0.01, float(w), 1.0, True) for v, w in zip(a, a[::-1])]
    df = spark.createDataFrame(rows, "a double, b double, c double, constant double, flag boolean")
    assert select.numeric_columns(df) == ["a", "b", "c", "constant"]
    assert select.correlated_features(df, 0.99) == ["b"]
    r = select.correlations(df)
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "constant"] is None
    assert r["a", "c"] == pytest.approx(np.corrcoef(a, a[::-1])[0, 1])
    line = spark.createDataFrame([(float(i), i + 0.01, float(-i)) for i in range(50)], "a double, b double, c double")
    assert select.correlated_features(line, 0.99) == ["b", "c"]


def test_correlations_use_pairwise_complete_rows(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 1.0), (None, 9.0, 5.0), (4.0, 6.0, 3.0), (5.0, 5.0, 8.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    ok = np.array([(a, b) for a, b, _ in rows if a is not None])
    assert select.correlations(df)["a", "b"] == pytest.approx(np.corrcoef(ok.T)[0, 1])


def test_variance_selection(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "constant double, variable double")
    assert select.select_by_variance(df, 0.01) == ["variable"]
    assert select.select_by_variance(df, 0.0) == ["variable"]
    with pytest.raises(ValueError):
        select.select_by_variance(df, 1e6)


def test_elimination_and_importance(spark, data):
    _, _, df = data
    spec = train.get_model("logistic_regression")
    kept, ranks = select.select_by_rfe(df, FEATURES, "y", spec, n_features=2)
    assert len(kept) == 2 and sorted(r for _, r in ranks) == [1, 1, 2, 3]
    left = list(FEATURES)
    while len(left) > 2:
        beta = train.fit(df, left, "y", spec).coefficients
        left.pop(int(np.argmin(np.square(beta))))
    assert kept == left
    model = train.LinearModel(["a", "b", "c"], [3.0, -1.0, 0.02], 9.0)
    assert select.select_by_importance(model, 0.01) == ["a", "b"]
    assert [tuple(r) for r in select.importances(spark, model).collect()] == [("a", 3.0), ("b", 1.0), ("c", 0.02)]
    with pytest.raises(ValueError):
        select.select_by_importance(object())


def wide_data(spark, width=501, n=300):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, width)).round(3)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=n) > 0).astype(int)
    names = [f"w{i}" for i in range(width)]
    rows = [(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    return names, spark.createDataFrame(rows, ["id", "y", *names])


def test_the_method_is_the_callers_choice_at_any_width(spark):
    names, df = wide_data(spark)
    spec = LogisticSpec(C=0.01, solver="liblinear", max_iter=100)
    models = [train.fit(df, names, "y", spec, method=m) for m in train.METHODS]
    np.testing.assert_allclose(models[0].coefficients, models[1].coefficients, atol=1e-3)
    kept, ranks = select_by_rfe(df, names, "y", spec, n_features=400, step=101, method="newton")
    assert len(kept) == 400 and len(ranks) == 501
    result = train.grid_search(df, names, "y", "id", grid={"C": [0.01], "solver": ["liblinear"]}, k=2)
    assert len(result.best_model.features) == 501
    with pytest.raises(ValueError, match="Unknown method"):
        train.fit(df, names, "y", spec, method="other")


def test_fits_cut_short_are_told_of(data):
    _, _, df = data
    with pytest.warns(RuntimeWarning, match="before"):
        model = train.fit(df, FEATURES, "y", LogisticSpec(C=100.0, max_iter=1))
    assert not model.converged and train.fit(df, FEATURES, "y", LogisticSpec()).converged


def scored_rows(n=3000):
    """Rows of which some are equal, one is very frequent and one lacks a number."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3)).round(1)
    x[n // 3: n // 2] = 0.5
    y = (x[:, 0] - x[:, 2] + rng.normal(size=n) > 0.1).astype(int)
    rows = [(i, int(t), int(i % 3), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    return rows + [(n, 1, 1, None, 0.0, 0.0)]


ROWS = "id bigint, y int, fold int, a double, b double, c double"


@pytest.mark.parametrize("bucket_rows", [10**6, 90, 7])
@pytest.mark.parametrize("buffer", [1 << 22, 500])
def test_areas_of_many_models_equal_areas_by_group(spark, monkeypatch, bucket_rows, buffer):
    monkeypatch.setattr(metrics, "AREA_BUFFER", buffer)
    df = spark.createDataFrame(scored_rows(), ROWS).repartition(3)
    models = [(c, f, beta) for f in range(3) for c, beta in enumerate(np.array([[1.0, 0.2, -0.9, 0.1], [0.3, -0.1, 0.0, 2.0], [0.0, 0.0, 0.0, 0.7]]) * (1 + f / 10))]
    got = {(r.candidate, r.fold): r.roc_auc for r in metrics.linear_aucs(newton.pack(df, ["a", "b", "c"], "y", "fold"), models, 1001, bucket_rows).collect()}
    assert len(got) == 9
    for c, f, (a, b, e, i) in models:
        held = df.where(F.col("fold") == f).withColumn("s", F.lit(0.0) + F.col("a") * float(a) + F.col("b") * float(b) + F.col("c") * float(e) + float(i))
        assert got[c, f] == pytest.approx(metrics.roc_auc(held, "s", "y").first()[0], abs=1e-12)
    one = newton.pack(df.where("y = 1"), ["a", "b", "c"], "y", "fold")
    assert {r.roc_auc for r in metrics.linear_aucs(one, models, 1001, bucket_rows).collect()} == {None}


def test_a_search_takes_few_steps_at_coefficients_of_its_own(spark, monkeypatch):
    df = spark.createDataFrame(scored_rows()[:-1], ROWS).drop("fold")
    seen, sums = [], newton._sums
    monkeypatch.setattr(newton, "_sums", lambda rows, d, fits: seen.append(len({b.tobytes() for _, b in fits})) or sums(rows, d, fits))
    grid = {"C": [0.1, 1, 10], "penalty": ["l1", "l2"], "solver": ["liblinear"], "class_weight": [None, "balanced"], "max_iter": [100]}
    found = train.grid_search(df, ["a", "b", "c"], "y", "id", grid=grid, k=5)
    assert found.cv_results.count() == 12 and sum(seen) <= 3 * 60


def test_elimination_reads_packed_blocks(spark, monkeypatch):
    """One value per block of rows is handed over in each pass, not one per number; every row and label is in a block."""
    rows = scored_rows()
    df, seen, sums = spark.createDataFrame(rows[:-1], ROWS).drop("fold"), [], newton._sums
    monkeypatch.setattr(newton, "_sums", lambda blocks, d, fits: seen.append((blocks.count(), len(blocks.columns))) or sums(blocks, d, fits))
    kept, ranks = select_by_rfe(df, ["a", "b", "c"], "y", LogisticSpec(), n_features=1)
    assert kept == ["a"] and dict(ranks) == {"a": 1, "b": 3, "c": 2} and seen and all(n < 40 and width == 2 for n, width in seen)
    packed = newton.pack(spark.createDataFrame(rows, ROWS).repartition(2), ["a", "b", "c"], "y", "fold")
    got = sorted((int(f), int(y), *x) for r in packed.collect() for b in [np.frombuffer(r["block"]).reshape(6, r["n"])] for f, y, *x in b.T if not np.isnan(x).any())
    assert got == sorted((f, y, a, b, c, 1.0) for _, y, f, a, b, c in rows if a is not None)
    assert sum(r["n"] for r in packed.collect()) == len(rows)
