"""Model versions as an append-only table, and the artifacts they point to."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.operators.prep import PrepParams, load_prep, save_prep
from clinrisk.operators.train import LinearModel, load_model, save_model
from clinrisk.operators.trees import TreeModel

VERSION_SCHEMA = ("model string, version string, created_at timestamp_ntz, path string,"
                  " metrics map<string,double>, metadata map<string,string>")
FIRST_VERSION = "1.0.0"


def version_key(version: str = "version") -> Column:
    """STRUCT<major, minor, patch> of integers, so that 1.0.9 sorts before 1.0.10."""
    parts = F.split(version, r"\.")
    return F.struct(*[F.get(parts, i).cast("int").alias(n) for i, n in enumerate(["major", "minor", "patch"])])


def latest_versions(versions: DataFrame) -> DataFrame:
    """The whole row of the newest version of each model, by a map-side-combined aggregate."""
    row = F.struct(*versions.columns)
    return versions.groupBy("model").agg(F.max_by(row, version_key()).alias("r")).select("r.*")


def next_versions(versions: DataFrame) -> DataFrame:
    """``(model, latest, next)`` with the patch number raised by one."""
    newest = versions.groupBy("model").agg(F.max(version_key()).alias("v"))
    dotted = F.concat_ws(".", "v.major", "v.minor", "v.patch")
    return newest.select("model", dotted.alias("latest"),
                         F.concat_ws(".", "v.major", "v.minor", F.col("v.patch") + 1).alias("next"))


def list_versions(versions: DataFrame, model: str | None = None) -> DataFrame:
    """Versions in numeric order (a range-partitioned sort; no per-model window)."""
    rows = versions if model is None else versions.where(F.col("model") == model)
    return rows.select("*", version_key().alias("_v")).orderBy("model", "_v").drop("_v")


def model_history(versions: DataFrame) -> DataFrame:
    """``(model, version, created_at, metric, value)``: one row per metric of each version."""
    return versions.select("model", "version", "created_at", F.explode("metrics").alias("metric", "value"))


def model_info(versions: DataFrame, default_threshold: float = 0.5) -> DataFrame:
    """Name, version, path, metrics and decision threshold of the newest version of each model."""
    threshold = F.coalesce(F.try_element_at("metadata", F.lit("threshold")).try_cast("double"), F.lit(default_threshold))
    return latest_versions(versions).select("model", "version", "path", "metrics", threshold.alias("threshold"))


class ModelRegistry:
    """Registry below one folder: ``versions/`` (Parquet rows) and ``artifacts/<model>_v<version>/``.

    Appending the row is the commit point. One writer at a time is assumed; the pair (model, version) is checked to be new.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSION_SCHEMA).parquet(f"{self.path}/versions")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], VERSION_SCHEMA)
            raise

    def next_version(self, model: str) -> str:
        row = next_versions(self.versions().where(F.col("model") == model)).first()
        return row["next"] if row else FIRST_VERSION

    def register(self, model: LinearModel | TreeModel, prep: PrepParams, metrics: Mapping[str, float], metadata: Mapping,
                 created_at: datetime | None = None) -> str:
        name = metadata.get("model_name", "unknown")
        version = self.next_version(name)
        path = f"{self.path}/artifacts/{name}_v{version}"
        save_model(model, dict(metadata), self.spark, path)
        save_prep(prep, self.spark, f"{path}/prep")
        if not self.versions().where((F.col("model") == name) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"Version exists: {name} v{version}")
        texts = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in metadata.items()}
        row = (name, version, created_at or datetime.now(UTC).replace(tzinfo=None), path, {k: float(v) for k, v in metrics.items()}, texts)
        self.spark.createDataFrame([row], VERSION_SCHEMA).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def info(self, name: str, version: str = "latest") -> dict:
        rows = self.versions().where(F.col("model") == name)
        rows = latest_versions(rows) if version == "latest" else rows.where(F.col("version") == version)
        row = rows.first()
        if row is None:
            raise ValueError(f"Model not found: {name} v{version}")
        return row.asDict(recursive=True)

    def load(self, name: str, version: str = "latest") -> tuple[LinearModel | TreeModel, PrepParams]:
        path = self.info(name, version)["path"]
        return load_model(self.spark, path), load_prep(self.spark, f"{path}/prep")

    def models(self) -> list[str]:
        return [r["model"] for r in self.versions().select("model").distinct().orderBy("model").collect()]

    def list_versions(self, name: str) -> list[str]:
        return [r["version"] for r in list_versions(self.versions(), name).collect()]
