"""Tree ensembles: random forests and boosted trees as a table of nodes, scored by expressions, without Python.

Spark ML grows the trees; what is kept is one row per node. The same table is what scoring, importances, saving and the
registry work on, so a model that was grown elsewhere can be brought in as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.scratch import remove, scratch_path

# kind: "vote" averages the leaves' class shares, "boost" takes the logistic function of twice the weighted sum of leaf values.
NODE_SCHEMA = ("kind string, tree int, weight double, node int, feature string, threshold double, left int, right int, value double,"
               " gain double, n double")
KINDS = {"random_forest": "vote", "gradient_boosting": "boost"}
# Trees whose values are summed in one piece of generated code.
TREES_TOGETHER = 4
# A model is part of every plan that scores with it.
MAX_NODES = 200_000


@dataclass(frozen=True)
class TreeSpec:
    """Hyperparameters of an ensemble. ``subsample`` is the share of rows that a tree sees, ``features_per_split`` as in Spark ML."""

    model: str = "random_forest"
    n_estimators: int = 100
    max_depth: int = 5
    min_samples_leaf: int = 1
    learning_rate: float = 0.1
    subsample: float = 1.0
    features_per_split: str = "auto"
    max_bins: int = 64
    class_weight: str | None = None
    random_state: int = 42

    def __post_init__(self):
        if self.model not in KINDS:
            raise ValueError(f"Unknown model: {self.model}. Available: {list(KINDS)}")
        if self.class_weight not in (None, "balanced") or self.n_estimators < 1 or not 0 <= self.max_depth <= 30 or not 0 < self.subsample <= 1:
            raise ValueError("Unsupported class_weight, n_estimators, max_depth or subsample")


@dataclass(frozen=True)
class Node:
    """A leaf has no feature; ``n`` is the weight of the training rows that reached the node."""

    node: int
    value: float
    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    gain: float = 0.0
    n: float = 0.0


@dataclass(frozen=True)
class TreeModel:
    """``trees``: nodes of each tree, the root first; rows with ``feature <= threshold`` go left, also where the feature is NULL."""

    kind: str
    features: list[str]
    trees: list[list[Node]]
    weights: list[float]

    def __post_init__(self):
        if self.kind not in KINDS.values() or not self.trees or len(self.weights) != len(self.trees):
            raise ValueError("An ensemble needs a known kind and a weight for each of its trees")
        if sum(map(len, self.trees)) > MAX_NODES:
            raise ValueError(f"More than {MAX_NODES} nodes")
        known = set(self.features)
        for tree in self.trees:
            nodes = {n.node: n for n in tree}
            for n in tree:
                if n.feature is not None and (n.feature not in known or n.left not in nodes or n.right not in nodes or min(n.left, n.right) <= n.node):
                    raise ValueError(f"Node {n.node} splits on an unknown feature or has no proper children")

    def values(self, features: dict[str, Column]) -> list[Column]:
        """One CASE expression per tree."""
        return [_walk({n.node: n for n in tree}, tree[0].node, features) for tree in self.trees]

    def probability(self, features: dict[str, Column]) -> Column:
        """The sum over trees is that of an array's elements, so that Spark can cut the generated code between trees."""
        weighted = [v * F.lit(float(w)) for v, w in zip(self.values(features), self.weights)]
        pieces = [reduce(lambda a, b: a + b, weighted[i:i + TREES_TOGETHER]) for i in range(0, len(weighted), TREES_TOGETHER)]
        total = pieces[0] if len(pieces) == 1 else F.aggregate(F.array(*pieces), F.lit(0.0), lambda a, x: a + x)
        if self.kind == "vote":
            return total / F.lit(float(sum(self.weights)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total))

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.kind, t, float(w), n.node, n.feature, n.threshold, n.left, n.right, float(n.value), float(n.gain), float(n.n))
                for t, (tree, w) in enumerate(zip(self.trees, self.weights)) for n in tree]
        # The features and their order, also of those that no tree splits on.
        rows += [("feature", i, 0.0, 0, f, None, None, None, 0.0, 0.0, 0.0) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @staticmethod
    def from_table(df: DataFrame) -> TreeModel:
        """At most MAX_NODES rows are read."""
        rows = sorted(df.limit(2 * MAX_NODES).collect(), key=lambda r: (r["tree"], r["node"]))
        names = [r["feature"] for r in rows if r["kind"] == "feature"]
        nodes = [r for r in rows if r["kind"] != "feature"]
        trees: dict[int, list[Node]] = {}
        weights: dict[int, float] = {}
        for r in nodes:
            trees.setdefault(r["tree"], []).append(Node(r["node"], r["value"], r["feature"], r["threshold"], r["left"], r["right"], r["gain"], r["n"]))
            weights[r["tree"]] = r["weight"]
        return TreeModel(nodes[0]["kind"], names, list(trees.values()), list(weights.values()))


def _walk(nodes: dict[int, Node], at: int, features: dict[str, Column]) -> Column:
    n = nodes[at]
    if n.feature is None:
        return F.lit(float(n.value))
    right = features[n.feature] > F.lit(float(n.threshold))
    return F.when(right, _walk(nodes, n.right, features)).otherwise(_walk(nodes, n.left, features))


def fit_trees(df: DataFrame, features: Sequence[str], label: str, spec: TreeSpec) -> TreeModel:
    """Grow an ensemble on the labelled rows; NULL features count as 0, as the preparation leaves none."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    n, pos = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    if pos in (0, n):
        raise ValueError("Training needs rows of both classes")
    weight = F.when(F.col("label") == 1, F.lit(n / (2 * pos))).otherwise(F.lit(n / (2 * (n - pos)))) if spec.class_weight == "balanced" else F.lit(1.0)
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(rows.withColumn("w", weight)).select("x", "label", "w")
    common = {"featuresCol": "x", "labelCol": "label", "weightCol": "w", "maxDepth": spec.max_depth, "minInstancesPerNode": spec.min_samples_leaf,
              "maxBins": spec.max_bins, "subsamplingRate": spec.subsample, "seed": spec.random_state}
    if spec.model == "random_forest":
        grower = RandomForestClassifier(numTrees=spec.n_estimators, featureSubsetStrategy=spec.features_per_split, **common)
    else:
        subset = "all" if spec.features_per_split == "auto" else spec.features_per_split
        grower = GBTClassifier(maxIter=spec.n_estimators, stepSize=spec.learning_rate, featureSubsetStrategy=subset, **common)
    fitted = grower.fit(data)
    return _nodes_of(df.sparkSession, fitted, list(features), KINDS[spec.model])


def _nodes_of(spark: SparkSession, fitted, features: list[str], kind: str) -> TreeModel:
    """Nodes from the saved form of a Spark ML model: a leaf's value is its share of class 1, or its prediction."""
    path = scratch_path(spark, "trees")
    fitted.write().overwrite().save(path)
    try:
        node = F.col("nodeData")
        split = node["split"]
        inner = node["leftChild"] >= 0
        stats = node["impurityStats"]
        total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value, n = (stats[1] / total, total) if kind == "vote" else (node["prediction"], stats[0])
        rows = spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(inner, split["featureIndex"]).alias("feature"), F.when(inner, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
            F.when(inner, node["leftChild"]).alias("left"), F.when(inner, node["rightChild"]).alias("right"), value.alias("value"), F.when(inner, node["gain"]).otherwise(0.0).alias("gain"),
            n.alias("n")).orderBy("tree", "node").limit(MAX_NODES + 1).collect()
    finally:
        remove(spark, path)
    trees: dict[int, list[Node]] = {}
    for r in rows:
        name = None if r["feature"] is None else features[r["feature"]]
        trees.setdefault(r["tree"], []).append(Node(r["node"], r["value"], name, r["threshold"], r["left"], r["right"], r["gain"], r["n"]))
    weights = [1.0] * len(trees) if kind == "vote" else [float(w) for w in fitted.treeWeights]
    return TreeModel(kind, features, [trees[t] for t in sorted(trees)], weights)


def node_importances(nodes: DataFrame) -> DataFrame:
    """``(feature, importance)`` of a node table: gains weighted by rows, summing to 1; features without a split have 0.

    In a forest each tree's gains are first brought to a sum of 1, so that every tree has one vote.
    """
    names = nodes.where("kind = 'feature'").select("feature")
    gains = nodes.where("kind <> 'feature' AND feature IS NOT NULL").groupBy("kind", "tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    per_tree = gains.groupBy("tree").agg(F.sum("g").alias("t"))
    shares = gains.join(per_tree, "tree").select("feature", F.when(F.col("kind") == "vote", F.coalesce(F.try_divide("g", "t"), F.lit(0.0))).otherwise(F.col("g")).alias("s"))
    by_feature = shares.groupBy("feature").agg(F.sum("s").alias("s"))
    total = by_feature.agg(F.sum("s").alias("total"))
    out = names.join(by_feature, "feature", "left").join(F.broadcast(total), how="cross")  # one row
    return out.select("feature", F.coalesce(F.try_divide("s", "total"), F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")


def leaves(model: TreeModel, features: dict[str, Column]) -> list[Column]:
    """For each tree, the number of the leaf that a row reaches."""
    numbered = replace(model, trees=[[replace(n, value=float(n.node)) for n in tree] for tree in model.trees])
    return [v.cast("int") for v in numbered.values(features)]


def refreshed(df: DataFrame, model: TreeModel, label: str) -> TreeModel:
    """``model`` with the rows, class shares and Gini gains that the nodes have on ``df``, a table of feature columns.

    One aggregate counts rows and positives per tree and leaf; inner nodes are sums of their leaves. Nodes that no row reaches
    keep their value and have no gain. Rows without a label are left out.
    """
    at = leaves(model, {f: F.col(f) for f in model.features})
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.posexplode(F.array(*at)).alias("tree", "leaf"))
    counts = rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_label") == 1).alias("pos")).collect()  # a row per leaf
    found = {(r["tree"], r["leaf"]): (r["n"], r["pos"]) for r in counts}
    trees = []
    for t, tree in enumerate(model.trees):
        total: dict[int, tuple[int, int]] = {}
        for n in reversed(tree):
            total[n.node] = found.get((t, n.node), (0, 0)) if n.feature is None else tuple(map(sum, zip(total[n.left], total[n.right])))

        def gini(node: int, total=total) -> float:
            n, pos = total[node]
            return 2 * pos / n * (1 - pos / n) if n else 0.0

        def gain(n: Node, total=total, gini=gini) -> float:
            rows = total[n.node][0]
            return gini(n.node) - sum(total[c][0] / rows * gini(c) for c in (n.left, n.right)) if n.feature is not None and rows else 0.0

        trees.append([replace(n, n=float(total[n.node][0]), gain=gain(n), value=total[n.node][1] / total[n.node][0] if total[n.node][0] and model.kind == "vote" else n.value) for n in tree])
    return replace(model, trees=trees)


def tree_probability(df: DataFrame, model: TreeModel, out: str = "probability") -> DataFrame:
    """Append the probability of a table of feature columns."""
    return df.withColumn(out, model.probability({f: F.col(f) for f in model.features}))
