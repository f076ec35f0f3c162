"""Training: patient table in, registered and evaluated model out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.functions.features import engineer_features
from clinrisk.operators import metrics, prep, quality
from clinrisk.operators.registry import ModelRegistry
from clinrisk.operators.score import Scorer
from clinrisk.operators.split import stratified_split
from clinrisk.operators.train import LinearModel, get_model, grid_search, train_model
from clinrisk.operators.trees import TreeModel
from clinrisk.scratch import landed, scratch_path
from clinrisk.sources.patients import validate_schema
from clinrisk.sources.splits import load_splits, save_splits


@dataclass(frozen=True)
class TrainConfig:
    key: str = "patient_id"
    label: str = "target"
    model_name: str = "logistic_regression"
    model_params: dict | None = None
    scaler: str = "standard"
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    seed: int = 42
    quality_checks: bool = True
    model_features: bool = True
    validation: bool = True
    tune: bool = False
    cv_folds: int = 5
    optimize_threshold: bool = True
    threshold_metric: str = "f1"
    threshold: float = 0.5
    grid: dict | None = None


# The short job: no quality checks, the 13 plain features, no validation, threshold 0.5.
SHORT = TrainConfig(quality_checks=False, model_features=False, validation=False, optimize_threshold=False)


@dataclass(frozen=True)
class TrainResult:
    scorer: Scorer
    metrics: DataFrame
    quality: dict = field(default_factory=dict)
    best_params: dict | None = None
    scores: dict = field(default_factory=dict)
    version: str | None = None


def check_quality(df: DataFrame) -> tuple[DataFrame, dict]:
    """Report missing values, outlier rows and broken rules; only rows with missing values are dropped."""
    missing = {r["column"]: r["n_missing"] for r in quality.missing_values(df).collect()}
    df = quality.drop_missing(df) if missing else df
    outliers = quality.outlier_rows(df).first()
    errors = [r["message"] for r in quality.violation_messages(df).collect()]
    return df, {"missing": missing, "n_outlier_rows": outliers["n_outlier_rows"], "errors": errors}


def train(df: DataFrame, config: TrainConfig = TrainConfig(), registry: ModelRegistry | None = None,
          splits_path: str | None = None) -> TrainResult:
    """Quality report, features, split, preprocessing, fit or search, threshold, test metrics, registration.

    Only counts, statistics and coefficients come to the driver. The input is read once and landed as Parquet, so that the
    quality and split passes scan single columns. The engineered and split table is written partitioned by split, and every
    later step reads just its part of it.
    """
    spark = df.sparkSession
    report: dict = {}
    if config.quality_checks:
        validate_schema(df)
    df = landed(df, "patients")
    if config.quality_checks:
        df, report = check_quality(df)
    table = stratified_split(engineer_features(df), config.key, config.label, config.train_ratio, config.val_ratio,
                             config.test_ratio, config.seed)
    splits_path = splits_path or scratch_path(spark, "splits")
    save_splits(table, splits_path)
    parts = {s: load_splits(spark, splits_path, s) for s in ("train", "val", "test")}

    spec = prep.model_spec(table.columns, config.scaler) if config.model_features else prep.PrepSpec(scaler=config.scaler)
    params = prep.fit_prep(parts["train"], spec)
    features = params.feature_names()
    keep = [config.key, config.label]
    x = {s: prep.transform(d, params, keep) for s, d in parts.items()}

    best_params, scores = None, {}
    if config.tune:
        search = grid_search(x["train"], features, config.label, config.key, config.model_name, config.grid, config.cv_folds,
                             config.seed)
        model, best_params, scores = search.best_model, search.best_params, {"cv_score": search.best_score}
    else:
        model, scores = train_model(x["train"], features, config.label, get_model(config.model_name, config.model_params),
                                    x["val"] if config.validation else None)

    threshold = config.threshold
    if config.optimize_threshold:
        threshold = metrics.best_threshold(_scored(x["val"], model, keep), "probability", config.label,
                                           config.threshold_metric).first()["threshold"]
    evaluated = metrics.evaluate(_scored(x["test"], model, keep), "probability", config.label, threshold)
    version = None
    if registry is not None:
        row = evaluated.first().asDict()
        version = registry.register(model, params, {k: v for k, v in row.items() if v is not None}, {
            "model_name": config.model_name, "features_used": features, "threshold": threshold, "tuned": config.tune,
            "best_params": best_params})
    return TrainResult(Scorer(params, model, threshold), evaluated, report, best_params, scores, version)


def _scored(x: DataFrame, model: LinearModel | TreeModel, keep: list[str]) -> DataFrame:
    return x.select(*keep, model.probability({f: F.col(f) for f in model.features}).alias("probability"))
