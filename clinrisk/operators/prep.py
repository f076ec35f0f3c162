"""Scaling and one-hot encoding: fit to a small parameter set, transform as a pure projection.

Spark ML's scalers and encoder are not used: they take the sample standard deviation, approximate medians, map a constant
to 0.5 and drop the last category, where population deviation, exact medians, 0 and the first category are wanted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.functions.features import Field
from clinrisk.operators.ordered import exact_quantiles
from clinrisk.schema import BINARY, CATEGORICAL, CONTINUOUS, ENGINEERED_NUMERIC

SCALERS = ["standard", "robust", "minmax"]
MAX_CATEGORIES = 1000
PARAMS_SCHEMA = "kind string, column string, position int, category string, dtype string, stat string, value double"
# How categories are stored: as text, with the name of their type.
PARSERS = {"int": int, "double": float, "string": str, "boolean": lambda text: text == "true"}
Category = int | float | str | bool | None


@dataclass(frozen=True)
class PrepSpec:
    continuous: list[str] = field(default_factory=lambda: list(CONTINUOUS))
    binary: list[str] = field(default_factory=lambda: list(BINARY))
    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL))
    scaler: str = "standard"

    def __post_init__(self):
        if self.scaler not in SCALERS:
            raise ValueError(f"Unknown scaler: {self.scaler}")

    def columns(self) -> list[str]:
        return [*self.continuous, *self.binary, *self.categorical]


def model_spec(columns: Iterable[str], scaler: str = "standard") -> PrepSpec:
    """The configured features that are present, plus engineered numerics and every interaction column."""
    columns = list(columns)
    continuous = [c for c in CONTINUOUS if c in columns]
    continuous += [c for c in ENGINEERED_NUMERIC if c in columns]
    continuous += [c for c in columns if "_x_" in c and c not in continuous]
    return PrepSpec(continuous, [c for c in BINARY if c in columns], [c for c in CATEGORICAL if c in columns], scaler)


@dataclass(frozen=True)
class PrepParams:
    """Fitted parameters: ``center`` and ``scale`` per continuous column, sorted categories (None last) per coded column."""

    spec: PrepSpec
    center: dict[str, float]
    scale: dict[str, float]
    categories: dict[str, list[Category]]

    def feature_columns(self, get: Field) -> dict[str, Column]:
        """Feature name -> expression; scaled columns, then passthrough, then one-hot by column and category."""
        out: dict[str, Column] = {}
        for c in self.spec.continuous:
            out[f"f_{c}"] = (get(c).cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c])
        for c in self.spec.binary:
            out[f"f_{c}"] = get(c).cast("double")
        for c in self.spec.categorical:
            for level in self.categories[c][1:]:
                if level is None:
                    out[f"f_{c}_null"] = get(c).isNull().cast("double")
                else:
                    out[f"f_{c}_{level}"] = F.coalesce((get(c) == F.lit(level)).cast("double"), F.lit(0.0))
        return out

    def feature_names(self) -> list[str]:
        names = [f"f_{c}" for c in [*self.spec.continuous, *self.spec.binary]]
        for c in self.spec.categorical:
            names += [f"f_{c}_{'null' if level is None else level}" for level in self.categories[c][1:]]
        return names

    def to_rows(self) -> list[tuple]:
        rows = [("spec", self.spec.scaler, 0, None, None, "scaler", None)]
        for i, c in enumerate(self.spec.continuous):
            rows += [("continuous", c, i, None, None, stat, of[c]) for stat, of in (("center", self.center), ("scale", self.scale))]
        rows += [("binary", c, i, None, None, "passthrough", None) for i, c in enumerate(self.spec.binary)]
        for i, c in enumerate(self.spec.categorical):
            rows += [("categorical", c, i, *_as_text(level), "level", float(j)) for j, level in enumerate(self.categories[c])]
        return rows

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_rows(), PARAMS_SCHEMA)

    @staticmethod
    def from_table(df: DataFrame) -> PrepParams:
        rows = sorted(df.collect(), key=lambda r: (r["position"], r["value"] if r["stat"] == "level" else 0))
        names = {kind: list(dict.fromkeys(r["column"] for r in rows if r["kind"] == kind))
                 for kind in ("continuous", "binary", "categorical")}
        scaler = next(r["column"] for r in rows if r["kind"] == "spec")
        stats = {stat: {r["column"]: r["value"] for r in rows if r["stat"] == stat} for stat in ("center", "scale")}
        levels: dict[str, list] = {c: [] for c in names["categorical"]}
        for r in rows:
            if r["stat"] == "level":
                levels[r["column"]].append(None if r["category"] is None else PARSERS[r["dtype"]](r["category"]))
        return PrepParams(PrepSpec(names["continuous"], names["binary"], names["categorical"], scaler),
                          stats["center"], stats["scale"], levels)


def _as_text(level: Category) -> tuple[str | None, str | None]:
    if level is None:
        return None, None
    if isinstance(level, bool):
        return str(level).lower(), "boolean"
    return (repr(level), "double") if isinstance(level, float) else (str(level), "int" if isinstance(level, int) else "string")


def fit_scaler(df: DataFrame, columns: list[str], scaler: str) -> tuple[dict[str, float], dict[str, float]]:
    """``(center, scale)`` per column; a zero spread scales by 1, a column without any value raises ``ValueError``."""
    if not columns:
        return {}, {}

    def present(found: dict) -> None:
        if empty := [c for c in columns if found[c] is None]:
            raise ValueError(f"No values in columns: {empty}")

    if scaler == "robust":
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        present({c: q[0] for c, q in quartiles.items()})
        center = {c: q[1] for c, q in quartiles.items()}
        scale = {c: q[2] - q[0] for c, q in quartiles.items()}
    else:
        low, spread = (F.avg, F.stddev_pop) if scaler == "standard" else (F.min, F.max)
        row = df.agg(*[a for c in columns for a in (low(c).alias(f"a_{c}"), spread(c).alias(f"b_{c}"))]).first()
        present({c: row[f"a_{c}"] for c in columns})
        center = {c: float(row[f"a_{c}"]) for c in columns}
        scale = {c: float(row[f"b_{c}"]) for c in columns}
        if scaler == "minmax":
            scale = {c: scale[c] - center[c] for c in columns}
    return center, {c: s if s > 0 else 1.0 for c, s in scale.items()}


def fit_categories(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[Category]]:
    """Sorted categories per column (NULL last) from one grouped pass; too many distinct values raise ``ValueError``.

    Categories keep their own type: integers, floating-point numbers, text or booleans. A column without any value has the
    category NULL only, and so no feature.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns])
    levels = df.select(F.inline(pairs)).distinct()
    types = {c: _kind(df.schema[c].dataType.typeName()) for c in columns}
    found: dict[str, list] = {c: [] for c in columns}
    for r in levels.limit(max_categories * len(columns) + 1).collect():
        kind = types[r["column"]]
        found[r["column"]].append(None if r["category"] is None else PARSERS[kind](r["category"]))
    crowded = [c for c in columns if len(found[c]) > max_categories]
    if crowded or sum(map(len, found.values())) > max_categories * len(columns):
        raise ValueError(f"More than {max_categories} categories in {crowded or columns}")
    return {c: sorted(x for x in v if x is not None) + [None] * (None in v) for c, v in found.items()}


def _kind(type_name: str) -> str:
    if type_name in ("byte", "short", "integer", "long"):
        return "int"
    if type_name in ("float", "double"):
        return "double"
    if type_name in ("string", "boolean"):
        return type_name
    raise ValueError(f"Categories of type {type_name} are not supported")


def fit_prep(df: DataFrame, spec: PrepSpec | None = None, max_categories: int = MAX_CATEGORIES) -> PrepParams:
    spec = PrepSpec() if spec is None else spec
    missing = [c for c in spec.columns() if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    center, scale = fit_scaler(df, spec.continuous, spec.scaler)
    return PrepParams(spec, center, scale, fit_categories(df, spec.categorical, max_categories))


def transform(df: DataFrame, params: PrepParams, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` columns and the features; works on batch and streaming DataFrames."""
    features = params.feature_columns(F.col)
    return df.select(*keep, *[e.alias(n) for n, e in features.items()])


def fit_transform(df: DataFrame, spec: PrepSpec | None = None, keep: Iterable[str] = ()) -> tuple[PrepParams, DataFrame]:
    params = fit_prep(df, spec)
    return params, transform(df, params, keep)


def scale_columns(df: DataFrame, columns: list[str], scaler: str) -> DataFrame:
    """Append ``<column>_scaled`` fitted on the table itself."""
    PrepSpec(scaler=scaler)
    center, scale = fit_scaler(df, columns, scaler)
    return df.withColumns({f"{c}_scaled": (F.col(c).cast("double") - F.lit(center[c])) / F.lit(scale[c]) for c in columns})


def save_prep(params: PrepParams, spark: SparkSession, path: str) -> None:
    params.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_prep(spark: SparkSession, path: str) -> PrepParams:
    return PrepParams.from_table(spark.read.parquet(path))
