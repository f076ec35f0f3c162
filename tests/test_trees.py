"""Tree ensembles: scoring, growing, importances, saving, selection, and odd inputs."""

import random

import pytest
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clinrisk.operators import prep, score, select, train, trees
from clinrisk.operators.registry import ModelRegistry
from clinrisk.operators.trees import Node, TreeModel, TreeSpec, fit_trees, node_importances, refreshed, tree_probability
from clinrisk.sources import derived
from clinrisk.streaming.scoring import scorer_of

FEATURES = ["a", "b", "c"]
TREE = [Node(0, 0.5, "a", 0.0, 1, 2), Node(1, 0.1), Node(2, 0.5, "b", 1.0, 3, 4), Node(3, 0.4), Node(4, 0.9)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b, c = rng.gauss(0, 1), rng.randrange(4), rng.random()
        rows.append((i, a, float(b), c, None if i % 50 == 0 else int((a > 0.3 and b >= 2) or rng.random() < 0.05)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").cache()


def by_hand(model, row):
    total = 0.0
    for tree, w in zip(model.trees, model.weights):
        nodes = {n.node: n for n in tree}
        n = tree[0]
        while n.feature is not None:
            value = row[n.feature]
            n = nodes[n.right if value is not None and value > n.threshold else n.left]
        total += w * n.value
    import math
    return total / sum(model.weights) if model.kind == "vote" else 1 / (1 + math.exp(-2 * total))


@pytest.mark.parametrize("kind", ["vote", "boost"])
def test_scoring_walks_each_tree(spark, table, kind):
    model = TreeModel(kind, FEATURES, [TREE, [Node(0, 0.25)], *[TREE] * 9], [0.5, 2.0, *[0.3] * 9])
    rows = table.unionByName(spark.createDataFrame([(900, None, 1.5, None, None), (901, 0.0, 1.0, 0.0, 1), (902, 0.1, None, 0.0, 1)], table.schema))
    for r in tree_probability(rows, model).collect():
        assert abs(r.probability - by_hand(model, r)) < 1e-12
    assert TreeModel.from_table(model.to_table(spark)) == model


@pytest.mark.parametrize("name,loader", [("random_forest", RandomForestClassificationModel), ("gradient_boosting", GBTClassificationModel)])
def test_grown_ensembles_score_as_spark_does(spark, table, name, loader, monkeypatch):
    kept = {}
    nodes_of = trees._nodes_of
    monkeypatch.setattr(trees, "_nodes_of", lambda s, fitted, *rest: kept.update(model=fitted) or nodes_of(s, fitted, *rest))
    model = fit_trees(table, FEATURES, "y", TreeSpec(name, n_estimators=6, max_depth=4))
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(table)
    fitted = kept["model"].setFeaturesCol("x")
    assert isinstance(fitted, loader)
    both = tree_probability(fitted.transform(data).select(*FEATURES, F.expr("probability").alias("vector"), "y"), model)
    for r in both.collect():
        assert abs(r.probability - r.vector[1]) < 1e-9
    hit = tree_probability(table, model).where("y IS NOT NULL").agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.93
    shares = {r.feature: r.importance for r in node_importances(model.to_table(spark)).collect()}
    expected = dict(zip(FEATURES, fitted.featureImportances.toArray()))
    assert all(abs(shares[f] - expected[f]) < 1e-6 for f in FEATURES) and abs(sum(shares.values()) - 1) < 1e-9


def test_refreshed_nodes_count_the_rows(spark, table):
    model = refreshed(table, TreeModel("vote", FEATURES, [TREE], [1.0]), "y")
    rows = [r for r in table.collect() if r.y is not None]
    reached = {0: rows, 1: [r for r in rows if r.a <= 0], 2: [r for r in rows if r.a > 0]}
    reached |= {3: [r for r in reached[2] if r.b <= 1], 4: [r for r in reached[2] if r.b > 1]}
    share = {k: sum(r.y for r in v) / len(v) for k, v in reached.items()}
    gini = {k: 2 * p * (1 - p) for k, p in share.items()}
    for n in model.trees[0]:
        assert n.n == len(reached[n.node]) and abs(n.value - share[n.node]) < 1e-12
    assert abs(model.trees[0][0].gain - (gini[0] - sum(len(reached[k]) / len(rows) * gini[k] for k in (1, 2)))) < 1e-12
    none = refreshed(table.where("false"), model, "y")
    assert {n.n for n in none.trees[0]} == {0.0} and {r.importance for r in node_importances(none.to_table(spark)).collect()} == {0.0}


def test_importances_and_selection(spark, table):
    model = train.fit(table, FEATURES, "y", train.get_model("random_forest", {"n_estimators": 8, "max_depth": 4}))
    ranked = [r.feature for r in select.importances(spark, model).collect()]
    assert set(ranked[:2]) == {"a", "b"} and "c" not in select.select_by_importance(model, 0.2) and set(select.select_by_importance(model, 0.2)) == {"a", "b"}


def test_models_by_name_and_wrong_parameters(table):
    assert train.get_model("random_forest") == TreeSpec("random_forest", 100, 10) and train.get_model("gradient_boosting", {}) == TreeSpec("gradient_boosting")
    for wrong in ({"class_weight": "heavy"}, {"n_estimators": 0}, {"subsample": 0.0}, {"max_depth": 31}):
        with pytest.raises(ValueError):
            train.get_model("random_forest", wrong)
    with pytest.raises(ValueError):
        fit_trees(table.where("y = 1"), FEATURES, "y", TreeSpec())
    with pytest.raises(ValueError):
        fit_trees(table.where("false"), FEATURES, "y", TreeSpec())
    for tree in ([Node(0, 0.5, "z", 0.0, 1, 2), Node(1, 0.0), Node(2, 1.0)], [Node(0, 0.5, "a", 0.0, 1, 9), Node(1, 0.0)], [Node(3, 0.5, "a", 0.0, 1, 2), Node(1, 0.0), Node(2, 1.0)]):
        with pytest.raises(ValueError):
            TreeModel("vote", FEATURES, [tree], [1.0])
    with pytest.raises(ValueError):
        TreeModel("vote", FEATURES, [], [])


def test_registered_trees_score_requests_and_rows_without_a_number(spark, sf, tmp_path):
    patients = derived.patients(spark, sf).limit(500)
    from clinrisk.functions.features import engineer_features
    rich = engineer_features(patients)
    params, x = prep.fit_transform(rich, prep.model_spec(rich.columns), ["target"])
    model = train.fit(x, params.feature_names(), "target", train.get_model("gradient_boosting", {"n_estimators": 3, "max_depth": 3}))
    models = ModelRegistry(spark, str(tmp_path / "registry"))
    models.register(model, params, {"roc_auc": 0.9}, {"model_name": "boosted", "threshold": "0.4"})
    scorer = scorer_of(models, "boosted", use_registered_threshold=True)
    assert isinstance(scorer.model, TreeModel) and scorer.model == model and scorer.threshold == 0.4
    direct = {r.id: r.probability for r in tree_probability(prep.transform(rich, params, [F.col("patient_id").alias("id")]), model).collect()}
    scored = score.score_table(patients, scorer).collect()
    assert len(scored) == 500 and all(abs(r.probability - direct[r.patient_id]) < 1e-12 for r in scored)
    missing = score.score_proba(patients.withColumn("age", F.lit(None).cast("int")), scorer).where("probability IS NOT NULL")
    assert missing.count() == 0
