"""Regularised logistic regression with class weights and a penalised intercept, and its grid search."""

from __future__ import annotations

import itertools
import json
import warnings
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.functions.scoring import linear_probability, prediction
from clinrisk.operators.metrics import linear_aucs
from clinrisk.operators.newton import FitTask, fit_checked, is_packed, pack, packed_counts
from clinrisk.operators.split import stratified_folds
from clinrisk.operators.trees import KINDS, TreeModel, TreeSpec, fit_trees
from clinrisk.sources.patients import estimated_megabytes

# Default hyperparameters and search grid per model name.
DEFAULT_PARAMS = {
    "logistic_regression": {"C": 1.0, "penalty": "l2", "solver": "liblinear", "max_iter": 200, "class_weight": "balanced"},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1, "class_weight": None, "random_state": 42},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "random_state": 42},
}
PARAM_GRIDS = {
    "logistic_regression": {
        "C": [0.001, 0.01, 0.1, 1, 10, 100],
        "penalty": ["l1", "l2"],
        "solver": ["liblinear"],
        "max_iter": [100, 200, 500],
        "class_weight": [None, "balanced"],
    },
}
TOLERANCE = 1e-8
METHODS = ("newton", "first_order")
SPLIT_MEGABYTES = 128
COEFFICIENT_SCHEMA = "position int, feature string, coefficient double"


@dataclass(frozen=True)
class LogisticSpec:
    """Hyperparameters; the values here are the library defaults, which an empty parameter dict means.

    ``solver="liblinear"`` penalises the intercept, ``"lbfgs"`` does not.
    """

    C: float = 1.0
    penalty: str = "l2"
    solver: str = "lbfgs"
    max_iter: int = 100
    class_weight: str | None = None

    def __post_init__(self):
        if self.penalty not in ("l1", "l2") or self.solver not in ("liblinear", "lbfgs"):
            raise ValueError(f"Unsupported penalty or solver: {self.penalty}, {self.solver}")
        if self.penalty == "l1" and self.solver == "lbfgs":
            raise ValueError("Solver lbfgs supports only the l2 penalty")
        if self.class_weight not in (None, "balanced") or self.C <= 0:
            raise ValueError(f"Unsupported class_weight or C: {self.class_weight}, {self.C}")


def get_model(name: str, params: dict | None = None) -> LogisticSpec | TreeSpec:
    """The model of that name; ``None`` takes our defaults, ``{}`` the library's."""
    if name not in DEFAULT_PARAMS:
        raise ValueError(f"Unknown model: {name}. Available: {list(DEFAULT_PARAMS)}")
    params = DEFAULT_PARAMS[name] if params is None else params
    if name in KINDS:
        return TreeSpec(name, **params)
    return LogisticSpec(**{k: v for k, v in params.items() if k != "random_state"})


@dataclass(frozen=True)
class LinearModel:
    """A fitted model: one coefficient per feature and an intercept."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    converged: bool = True

    def probability(self, features: dict[str, Column]) -> Column:
        return linear_probability(features, dict(zip(self.features, self.coefficients)), self.intercept)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, float(b)) for i, (f, b) in enumerate(zip(self.features, self.coefficients))]
        return spark.createDataFrame([*rows, (len(rows), "(intercept)", float(self.intercept))], COEFFICIENT_SCHEMA)

    @staticmethod
    def from_table(df: DataFrame) -> LinearModel:
        rows = sorted(df.collect(), key=lambda r: r["position"])
        return LinearModel([r["feature"] for r in rows[:-1]], [r["coefficient"] for r in rows[:-1]], rows[-1]["coefficient"])


def training_matrix(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = (), split_megabytes: int = SPLIT_MEGABYTES) -> DataFrame:
    """Labelled rows as ``(*keep, label, features...)``, cached until ``unpersist`` (a lost executor's part is recomputed).

    A table too small to give every core a file split of ``split_megabytes`` is spread over the cores once, because every
    step works on it. This changes the partitioning, and so at most the last digits of sums.
    """
    return _training_rows(df, features, label, keep, split_megabytes).persist(StorageLevel.MEMORY_AND_DISK)


def _training_rows(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = (), split_megabytes: int = SPLIT_MEGABYTES) -> DataFrame:
    rows = df.where(F.col(label).isNotNull()).select(*keep, F.col(label).alias("label"), *features)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if estimated_megabytes(df) < cores * split_megabytes else rows


def fitting_data(df: DataFrame, features: Sequence[str], label: str, method: str = "newton", fold: str | None = None) -> DataFrame:
    """What the method's steps read, cached until ``unpersist``: packed blocks for ``newton``, else the training matrix."""
    keep = [fold] if fold else []
    if method != "newton":
        return training_matrix(df, features, label, keep)
    return pack(_training_rows(df, features, label, keep), features, "label", fold).persist(StorageLevel.MEMORY_AND_DISK)


def matrix_counts(matrix: DataFrame, by: Sequence[str] = ()) -> list:
    if is_packed(matrix):
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "pos")]
        return packed_counts(matrix).groupBy(*by).agg(*sums).collect()
    return matrix.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos")).collect()


def class_weights(n: int, pos: int, spec: LogisticSpec) -> tuple[float, float]:
    """Weights of labels 0 and 1; balanced weights give both classes the same total."""
    if pos in (0, n):
        raise ValueError("Training needs rows of both classes")
    return (n / (2 * (n - pos)), n / (2 * pos)) if spec.class_weight == "balanced" else (1.0, 1.0)


def fit_task(n: int, pos: int, spec: LogisticSpec, fold: int | None = None, **options) -> FitTask:
    return FitTask(spec.C, class_weights(n, pos, spec), spec.penalty == "l1", spec.solver == "liblinear", fold,
                   spec.max_iter, **options)


def fit_wide(matrix: DataFrame, features: Sequence[str], n: int, pos: int, spec: LogisticSpec) -> tuple[list[float], float]:
    """Coefficients and intercept by Spark ML's L-BFGS / OWL-QN, whose cost is linear in the number of features.

    Spark leaves its intercept unpenalised and ignores constant columns. For a penalised intercept a column of ones is
    appended and, for a fixed pseudo-random half of the rows, the feature vector and the label are both flipped: the
    logistic loss is the same, and the bias column is now -1 / +1, an ordinary penalised feature.
    """
    weight0, weight1 = class_weights(n, pos, spec)
    weight = F.when(F.col("label") == 1, F.lit(weight1)).otherwise(F.lit(weight0))
    flipped = spec.solver == "liblinear"
    keep = (F.pmod(F.xxhash64(*features), F.lit(2)) == 0) if flipped else F.lit(True)
    sign = F.when(keep, F.lit(1.0)).otherwise(F.lit(-1.0))
    rows = matrix.select(
        F.when(keep, F.col("label")).otherwise(1 - F.col("label")).cast("double").alias("y"), weight.alias("w"),
        *[(F.col(f) * sign).alias(f) for f in features], sign.alias("_bias"))
    inputs = [*features, "_bias"] if flipped else list(features)
    data = VectorAssembler(inputCols=inputs, outputCol="x").transform(rows).select("x", "y", "w")
    lr = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", standardization=False, tol=TOLERANCE, maxIter=spec.max_iter,
        regParam=1.0 / (spec.C * n), elasticNetParam=1.0 if spec.penalty == "l1" else 0.0, fitIntercept=not flipped)
    fitted = lr.fit(data)
    beta = [float(b) for b in fitted.coefficients.toArray()]
    if fitted.summary.totalIterations >= spec.max_iter:
        warnings.warn("the fit ended before it had converged", RuntimeWarning, stacklevel=2)
    return (beta[:-1], beta[-1]) if flipped else (beta, float(fitted.intercept))


def solve_many(
    matrix: DataFrame, features: Sequence[str], tasks: Sequence[tuple[int, int, LogisticSpec, FitTask]], fold: str | None = None,
    method: str = "newton",
) -> tuple[list[np.ndarray], list[bool]]:
    """Coefficients (intercept last) of several fits over a training matrix, and whether each converged.

    ``tasks``: rows and positive rows of the fit, its spec, and its FitTask. ``newton`` advances all fits together, a pass
    over the data per step and a block of the squared number of features per fit; ``first_order`` runs Spark ML's solver fit
    by fit, for feature lists whose square is too large. The method is the caller's choice at any width.
    """
    if method == "newton":
        return fit_checked(matrix, features, "label", [t for *_, t in tasks], fold)
    if method != "first_order":
        raise ValueError(f"Unknown method {method!r}, not one of {METHODS}")
    betas, converged = [], []
    for n, pos, spec, task in tasks:
        free = [f for i, f in enumerate(features) if task.free is None or task.free[i]]
        rows = matrix if task.fold is None else matrix.where(F.col(fold) != task.fold)
        with warnings.catch_warnings(record=True) as told:
            warnings.simplefilter("always", RuntimeWarning)
            coefficients, intercept = fit_wide(rows, free, n, pos, spec)
        found = dict(zip(free, coefficients))
        betas.append(np.array([*(found.get(f, 0.0) for f in features), intercept]))
        converged.append(not any(issubclass(w.category, RuntimeWarning) for w in told))
    return betas, converged


def fit(df: DataFrame, features: Sequence[str], label: str, spec: LogisticSpec | TreeSpec, method: str = "newton") -> LinearModel | TreeModel:
    """Fit one model; ``method``, for logistic regression, as in ``solve_many``."""
    if isinstance(spec, TreeSpec):
        return fit_trees(df, features, label, spec)
    matrix = fitting_data(df, features, label, method)
    try:
        c = matrix_counts(matrix)[0]
        task = (c["n"], c["pos"], spec, fit_task(c["n"], c["pos"], spec))
        (beta,), (done,) = solve_many(matrix, features, [task], method=method)
    finally:
        matrix.unpersist()
    if not done:
        warnings.warn("the fit ended before it had converged", RuntimeWarning, stacklevel=2)
    return LinearModel(list(features), beta[:-1].tolist(), float(beta[-1]), done)


def optimality(df: DataFrame, model: LinearModel, label: str, spec: LogisticSpec) -> DataFrame:
    """``(position, feature, residual)``: how far each coefficient's optimality condition is missed, per labelled row and unit of C.

    For an L2 penalty that is the gradient of penalty and weighted loss; for L1 the distance of the loss's slope from -sign of the
    coefficient, or from [-1, 1] where it is 0. An intercept that is not penalised has its slope. One pass over ``df``, a table of feature columns.
    """
    rows = df.where(F.col(label).isNotNull())
    n, pos = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    weight0, weight1 = class_weights(n, pos, spec)
    error = (model.probability({f: F.col(f) for f in model.features}) - F.col(label)) * F.when(F.col(label) == 1, F.lit(weight1)).otherwise(F.lit(weight0))
    sums = rows.withColumn("_e", error).agg(*[F.sum(F.col("_e") * F.col(f)).alias(f"s{i}") for i, f in enumerate(model.features)], F.sum("_e").alias(f"s{len(model.features)}")).first()
    out = []
    for i, (f, b) in enumerate(zip([*model.features, "(intercept)"], [*model.coefficients, model.intercept])):
        slope = spec.C * sums[f"s{i}"]
        if f == "(intercept)" and spec.solver == "lbfgs":
            missed = abs(slope)
        elif spec.penalty == "l2":
            missed = abs(b + slope)
        else:
            missed = abs(slope + (1 if b > 0 else -1)) if b else max(0.0, abs(slope) - 1)
        out.append((i, f, missed / (spec.C * n)))
    return df.sparkSession.createDataFrame(out, "position int, feature string, residual double")


def save_model(model: LinearModel | TreeModel, metadata: dict, spark: SparkSession, path: str) -> None:
    """``path/model`` (table of coefficients or nodes) and ``path/metadata`` (one JSON line)."""
    model.to_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    line = json.dumps(metadata, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> LinearModel | TreeModel:
    """From the folder given to ``save_model`` or from its table of coefficients or nodes."""
    path = path.rstrip("/")
    table = spark.read.parquet(path if path.endswith("/model") else f"{path}/model")
    return (TreeModel if "tree" in table.columns else LinearModel).from_table(table)


def accuracy(df: DataFrame, model: LinearModel | TreeModel, label: str, threshold: float = 0.5) -> DataFrame:
    """One row ``(n, accuracy)`` of a table of feature columns."""
    p = model.probability({f: F.col(f) for f in model.features})
    hit = (prediction(p, threshold) == F.col(label)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def train_model(df: DataFrame, features: Sequence[str], label: str, spec: LogisticSpec | TreeSpec,
                validation: DataFrame | None = None) -> tuple[LinearModel | TreeModel, dict[str, float]]:
    """Fit, and the accuracy on the training and (if given) validation rows."""
    model = fit(df, features, label, spec)
    scores = {"train_accuracy": accuracy(df, model, label).first()["accuracy"]}
    if validation is not None:
        scores["val_accuracy"] = accuracy(validation, model, label).first()["accuracy"]
    return model, scores


def grid_points(grid: dict) -> list[dict]:
    """All combinations; names in alphabetical order, the last varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


@dataclass(frozen=True)
class SearchResult:
    best_params: dict
    best_score: float
    best_model: LinearModel
    cv_results: DataFrame


def grid_search(
    df: DataFrame, features: Sequence[str], label: str, key: str, name: str = "logistic_regression",
    grid: dict | Sequence[dict] | None = None, k: int = 5, seed: int = 42, method: str = "newton",
) -> SearchResult:
    """Every point of a grid, or of a list of points, on ``k`` stratified folds, scored by mean fold AUC; the first best is refitted on all rows.

    All ``points x folds`` fits advance together over one cached matrix. With ``newton`` they start from a fit on all rows, one
    per class weight and solver, whose optimum is near theirs: they share its products, and few steps are left to make at their
    own coefficients. The fold models are then applied together to the rows of their fold, and one job gives all AUCs; being
    exact, it orders each held-out row once per distinct point. ``max_iter`` only stops a fit early, so points that differ in
    nothing else share the fit with the largest value.
    """
    base = get_model(name, {})
    points = grid_points(PARAM_GRIDS[name] if grid is None else grid) if grid is None or isinstance(grid, dict) else list(grid)
    specs = [LogisticSpec(**{**asdict(base), **p}) for p in points]

    def identity(s: LogisticSpec) -> tuple:
        return s.C, s.penalty, s.solver, s.class_weight

    fits: dict[tuple, LogisticSpec] = {}
    for s in specs:
        if identity(s) not in fits or fits[identity(s)].max_iter < s.max_iter:
            fits[identity(s)] = s
    ids = {ident: i for i, ident in enumerate(fits)}
    matrix = fitting_data(stratified_folds(df, key, label, k, seed), features, label, method, "fold")
    try:
        counts = {r["fold"]: r for r in matrix_counts(matrix, ["fold"])}
        total = {c: sum(r[c] for r in counts.values()) for c in ("n", "pos")}
        jobs = list(itertools.product(fits, sorted(counts)))
        starts = _leaders(matrix, features, list(fits.values()), total) if method == "newton" else {}
        tasks = []
        for ident, f in jobs:
            n, pos = total["n"] - counts[f]["n"], total["pos"] - counts[f]["pos"]
            tasks.append((n, pos, fits[ident], fit_task(n, pos, fits[ident], f, start=starts.get(_family(fits[ident])))))
        spark = df.sparkSession
        betas, _ = solve_many(matrix, features, tasks, "fold", method)
        models = [(ids[ident], f, beta) for (ident, f), beta in zip(jobs, betas)]
        packed = matrix if is_packed(matrix) else pack(matrix, features, "label", "fold")
        aucs: dict[int, dict[int, float]] = {}
        for r in linear_aucs(packed, models, max(c["n"] for c in counts.values())).collect():  # points x folds rows
            aucs.setdefault(r["candidate"], {})[r["fold"]] = r["roc_auc"]
        mean = {c: sum(v.values()) / len(v) for c, v in aucs.items()}
        scores = [mean[ids[identity(s)]] for s in specs]
        best = scores.index(max(scores))
        chosen = (total["n"], total["pos"], specs[best], fit_task(total["n"], total["pos"], specs[best], start=starts.get(_family(specs[best]))))
        (beta,), (done,) = solve_many(matrix, features, [chosen], method=method)
    finally:
        matrix.unpersist()
    order = sorted(range(len(points)), key=lambda i: -scores[i])
    rank = {i: 1 + sum(scores[j] > scores[i] for j in order) for i in order}
    rows = [
        (i, float(s.C), s.class_weight, s.max_iter, s.penalty, s.solver,
         [aucs[ids[identity(s)]][f] for f in sorted(counts)], scores[i], rank[i])
        for i, s in enumerate(specs)
    ]
    results = spark.createDataFrame(
        rows, "point int, C double, class_weight string, max_iter int, penalty string, solver string,"
              " fold_scores array<double>, mean_score double, rank int")
    return SearchResult(points[best], scores[best], LinearModel(list(features), beta[:-1].tolist(), float(beta[-1]), done), results)


def _family(spec: LogisticSpec) -> tuple:
    return spec.class_weight, spec.solver


def _leaders(matrix: DataFrame, features: Sequence[str], specs: Sequence[LogisticSpec], total: dict) -> dict[tuple, np.ndarray]:
    """Coefficients on all rows of one fit per class weight and solver, that of the middle ``C``, L2 before L1."""
    leaders = {}
    for family in dict.fromkeys(map(_family, specs)):
        ridge = [s for s in specs if _family(s) == family and s.penalty == "l2"] or [s for s in specs if _family(s) == family]
        leaders[family] = sorted(ridge, key=lambda s: s.C)[len(ridge) // 2]
    tasks = [(total["n"], total["pos"], s, fit_task(total["n"], total["pos"], s)) for s in leaders.values()]
    betas, _ = solve_many(matrix, features, tasks)
    return dict(zip(leaders, betas))


# Choices are lists, ranges are (low, high) and drawn evenly on a logarithmic scale.
RANDOM_SPACES = {"logistic_regression": {"C": (0.001, 100.0), "penalty": ["l1", "l2"], "solver": ["liblinear"], "class_weight": [None, "balanced"]}}
RUNG_SCHEMA = "rung int, share double, point int, params map<string,string>, mean_score double, kept boolean"
_SHARES = 1 << 20


def random_points(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` points of a space of choices and ranges; the same for the same seed, and the first of more."""
    rng, names, out = np.random.default_rng(seed), sorted(space), []
    for _ in range(n):
        draw = dict(zip(names, rng.random(len(names))))
        out.append({c: v[int(draw[c] * len(v))] if isinstance(v, list) else float(v[0] * (v[1] / v[0]) ** draw[c]) for c, v in space.items()})
    return out


def random_search(
    df: DataFrame, features: Sequence[str], label: str, key: str, name: str = "logistic_regression", space: dict | None = None,
    n: int = 27, eta: int = 3, k: int = 5, seed: int = 42, method: str = "newton",
) -> tuple[SearchResult, DataFrame]:
    """Random points, of which each rung keeps the best in ``eta`` on ``eta`` times as many rows; the last rung has all rows.

    Rows of a rung are those whose hashed key is below its share, so that a rung holds those of the rung before. A rung that has not two
    rows of each label per fold decides nothing; rows without a label take no part. Returns the search of the last rung, refitted on all rows, and a table of the rungs.
    """
    if n < 1 or eta < 2:
        raise ValueError("A search needs a point, and eta of 2 or more")
    df = df.where(F.col(label).isNotNull())
    points = random_points(RANDOM_SPACES[name] if space is None else space, n, seed)
    left, spark, table, rung = list(range(n)), df.sparkSession, [], 0
    shares = [1.0]
    while eta ** len(shares) < n:
        shares.insert(0, shares[0] / eta)
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(_SHARES))
    for rung, share in enumerate(shares):
        rows = df if share == 1.0 else df.where(place < F.lit(int(share * _SHARES)))
        last = rung == len(shares) - 1
        if not last:
            counts = rows.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
            if min(counts) < 2 * k:
                continue
        result = grid_search(rows, features, label, key, name, [points[i] for i in left], k, seed, method)
        scores = {i: r["mean_score"] for i, r in zip(left, sorted(result.cv_results.collect(), key=lambda r: r["point"]))}
        best = sorted(left, key=lambda i: (-scores[i], i))[:1 if last else max(1, -(-len(left) // eta))]
        table += [(rung, share, i, {c: str(v) for c, v in points[i].items()}, scores[i], i in best) for i in left]
        left = sorted(best)
    return result, spark.createDataFrame(table, RUNG_SCHEMA)
