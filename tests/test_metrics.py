import math

import numpy as np
import pytest

from clinrisk.operators import metrics as M

Y = [0, 0, 1, 1, 1, 0, 1, 0, 1, 1]
PRED = [0, 1, 1, 1, 0, 0, 1, 0, 1, 1]
P = [.2, .6, .8, .9, .4, .3, .7, .1, .85, .75]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(zip(Y, PRED, P)), "y int, pred int, p double").repartition(3).persist()


def test_all_metrics(df):
    row = M.all_metrics(df, "y", "pred", "p").first()
    assert row["accuracy"] == 0.8 and row["specificity"] == 0.75 and row["npv"] == 0.75
    assert row["precision"] == row["recall"] == row["f1"] == pytest.approx(5 / 6)
    assert row["roc_auc"] == pytest.approx(0.9583333333) and row["pr_auc"] == pytest.approx(0.9761904762)
    assert "roc_auc" not in M.all_metrics(df, "y", "pred").columns


def test_medical_metrics_and_confusion(df):
    row = M.medical_metrics(df, "y", "pred", "p").first()
    assert (row["true_positives"], row["false_negatives"], row["false_positives"], row["true_negatives"]) == (5, 1, 1, 3)
    assert row["disease_prevalence"] == 0.6 and row["total_patients"] == 10
    cells = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(df, "y", "pred").collect()}
    assert cells == {("Healthy", "Healthy"): 3, ("Healthy", "Heart Disease"): 1, ("Heart Disease", "Healthy"): 1,
                     ("Heart Disease", "Heart Disease"): 5}


def test_single_class_gives_zeros_and_null_auc(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.3)], "y int, pred int, p double")
    row = M.all_metrics(df, "y", "pred", "p").first()
    assert row["accuracy"] == 1.0 and row["precision"] == row["recall"] == row["f1"] == 0.0 and row["roc_auc"] is None
    assert M.confusion_matrix(df, "y", "pred").count() == 4


def test_class_report(df):
    rows = {r["class"]: r for r in M.class_report(df, "y", "pred").collect()}
    assert rows["0"]["f1"] == 0.75 and rows["0"]["support"] == 4 and rows["1"]["recall"] == pytest.approx(5 / 6)
    assert rows["accuracy"]["f1"] == 0.8 and rows["accuracy"]["precision"] is None
    assert rows["macro avg"]["precision"] == pytest.approx((0.75 + 5 / 6) / 2)
    assert rows["weighted avg"]["precision"] == pytest.approx((0.75 * 4 + 5 / 6 * 6) / 10)


def roc_brute(y, p):
    """Cumulative counts per distinct score, then points whose second difference is not zero."""
    t = sorted(set(p), reverse=True)
    tps = [sum(a for a, s in zip(y, p) if s >= c) for c in t]
    fps = [sum(1 - a for a, s in zip(y, p) if s >= c) for c in t]
    keep = [i for i in range(len(t)) if i in (0, len(t) - 1) or tps[i + 1] - 2 * tps[i] + tps[i - 1] or fps[i + 1] - 2 * fps[i] + fps[i - 1]]
    return [(math.inf, 0.0, 0.0)] + [(t[i], fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep]


def flat(rows):
    return [x for row in rows for x in row]


def test_curves(spark, df):
    got = [tuple(r) for r in M.roc_curve(df, "p", "y").orderBy("fpr", "tpr").collect()]
    assert flat(got) == pytest.approx(flat(roc_brute(Y, P)))
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in M.pr_curve(df, "p", "y").collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.6] == pytest.approx((5 / 6, 5 / 6)) and len(pr) == 11
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 500).tolist(), np.round(rng.random(500), 2).tolist()
    big = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    assert flat(sorted(M.roc_curve(big, "p", "y").collect())) == pytest.approx(flat(sorted(roc_brute(y, p))))


def test_auc_by_group(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(y), float(np.round(s + y * g, 1))) for g, y, s in zip(rng.integers(0, 3, 600), rng.integers(0, 2, 600), rng.normal(size=600))]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    for r in M.auc_by(df, "s", "y", ["g"]).collect():
        pos = np.array([s for g, y, s in rows if g == r["g"] and y == 1])
        neg = np.array([s for g, y, s in rows if g == r["g"] and y == 0])
        pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
        assert r["roc_auc"] == pytest.approx(pairs)


def test_calibration_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.11, 1), (1.0, 0)], "p double, y int")
    rows = {r["bin"]: (r["n"], r["positive_fraction"]) for r in M.calibration(df, "p", "y").collect()}
    assert rows == {0: (2, 0.5), 1: (1, 1.0), 9: (1, 0.0)}


@pytest.mark.parametrize("objective", M.OBJECTIVES)
def test_threshold_search_equals_trying_all(spark, objective):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    p = np.clip(np.round(0.5 + 0.2 * (y - 0.5) + 0.2 * rng.normal(size=300), 2), 0, 1)
    grid = np.arange(0.1, 0.9, 0.01)

    def value(t):
        h = p >= t
        tp, fp, fn, tn = (h & (y == 1)).sum(), (h & (y == 0)).sum(), (~h & (y == 1)).sum(), (~h & (y == 0)).sum()
        rec, spec, prec = tp / (tp + fn), tn / (tn + fp), tp / (tp + fp) if tp + fp else 0.0
        return {"f1": 2 * tp / (2 * tp + fp + fn), "recall": rec, "precision": prec, "youden": rec + spec - 1}[objective]

    scores = [value(t) for t in grid]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    row = M.best_threshold(df, "p", "y", objective).first()
    assert row["threshold"] == float(grid[int(np.argmax(scores))]) and row["score"] == pytest.approx(max(scores))


def test_threshold_grid_and_errors(df):
    grid = M.threshold_grid()
    assert len(grid) == 80 and grid[-1] == 0.8899999999999996
    assert 0.1 <= M.best_threshold(df, "p", "y").first()["threshold"] <= 0.9
    with pytest.raises(ValueError, match="Unknown metric"):
        M.best_threshold(df, "p", "y", "gain")


def test_evaluate(df):
    row = M.evaluate(df, "p", "y", 0.5).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (5, 1, 1, 3) and row["threshold"] == 0.5
