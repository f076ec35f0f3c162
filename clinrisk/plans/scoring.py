"""Scoring jobs: tables, request batches and payloads with a registered model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clinrisk.operators.registry import ModelRegistry
from clinrisk.operators.score import score_payloads, score_requests, score_service, score_table
from clinrisk.streaming.scoring import scorer_of

JOBS = {"table": score_table, "requests": score_requests, "payloads": score_payloads}


def score(df: DataFrame, registry: ModelRegistry, model: str = "logistic_regression", version: str = "latest",
          kind: str = "table", use_registered_threshold: bool = False) -> DataFrame:
    """Score ``df`` (kind: table, requests, payloads or service) with a registered model, newest by default."""
    scorer = scorer_of(registry, model, version, use_registered_threshold)
    if kind == "service":
        return score_service(df, scorer, df.columns)
    if kind not in JOBS:
        raise ValueError(f"Unknown scoring job: {kind}")
    return JOBS[kind](df, scorer)
