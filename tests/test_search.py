"""Random search with early elimination, optimality of fits, and elimination on two features."""

import random

import pytest

from clinrisk.operators import train

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(6), []
    for i in range(1500):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, c, None if i % 70 == 0 else int(2 * a - b + rng.gauss(0, 1) > 0.8)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").cache()


def test_points_are_seeded_and_inside_their_space():
    space = {"C": (0.01, 10.0), "penalty": ["l1", "l2"]}
    points = train.random_points(space, 50, seed=3)
    assert points == train.random_points(space, 50, seed=3) and points[:20] == train.random_points(space, 20, seed=3) != train.random_points(space, 20, seed=4)
    assert all(0.01 <= p["C"] <= 10 and p["penalty"] in ("l1", "l2") for p in points) and {p["penalty"] for p in points} == {"l1", "l2"}
    assert 10 < sum(p["C"] < 0.316 for p in points) < 40


def test_rungs_keep_a_third_and_end_on_all_rows(table):
    space = {"C": (0.00001, 1.0), "penalty": ["l2"], "solver": ["liblinear"], "class_weight": ["balanced"]}
    result, rungs = train.random_search(table, FEATURES, "y", "id", space=space, n=9, k=3)
    rows = rungs.collect()
    counts = {}
    for r in rows:
        counts.setdefault((r.rung, r.share), []).append(r)
    assert [(k, len(v), sum(r.kept for r in v)) for k, v in sorted(counts.items())] == [((0, 1 / 3), 9, 3), ((1, 1.0), 3, 1)]
    assert {r.point for r in rows if r.rung == 1} == {r.point for r in rows if r.rung == 0 and r.kept}
    full = train.grid_search(table.where("y IS NOT NULL"), FEATURES, "y", "id", grid=train.random_points(space, 9), k=3)
    assert abs(result.best_score - full.best_score) < 0.002
    winner = next(r for r in rows if r.rung == 1 and r.kept)
    assert float(winner.params["C"]) == result.best_params["C"] and abs(winner.mean_score - result.best_score) < 1e-12


def test_rungs_without_enough_rows_decide_nothing(spark, table):
    few = table.where("id < 40")
    result, rungs = train.random_search(few, FEATURES, "y", "id", n=9, k=2)
    assert {r.share for r in rungs.collect()} <= {1 / 3, 1.0} and result.best_model.features == FEATURES
    for wrong in ({"n": 0}, {"eta": 1}):
        with pytest.raises(ValueError):
            train.random_search(few, FEATURES, "y", "id", **wrong)
    with pytest.raises(ValueError):
        train.random_search(table.where("y = 1"), FEATURES, "y", "id", n=1)


@pytest.mark.parametrize("penalty,solver,weight", [("l2", "liblinear", "balanced"), ("l2", "lbfgs", None), ("l1", "liblinear", "balanced")])
def test_residuals_are_zero_at_the_optimum_only(table, penalty, solver, weight):
    spec = train.LogisticSpec(0.05, penalty, solver, 200, weight)
    model = train.fit(table, FEATURES, "y", spec)
    assert max(r.residual for r in train.optimality(table, model, "y", spec).collect()) < 1e-7
    moved = train.LinearModel(FEATURES, [b + 0.01 for b in model.coefficients], model.intercept)
    assert max(r.residual for r in train.optimality(table, moved, "y", spec).collect()) > 1e-4
