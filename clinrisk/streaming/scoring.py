"""Streaming scoring with a fixed model, or with the newest registered model of each micro-batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clinrisk.operators.registry import ModelRegistry
from clinrisk.operators.score import DEFAULT_THRESHOLD, Scorer, score_service
from clinrisk.streaming.runner import start_append, start_batches


def scorer_of(registry: ModelRegistry, name: str, version: str = "latest", use_registered_threshold: bool = False) -> Scorer:
    """The registered model as a scorer; its tuned threshold is used only on request."""
    model, prep = registry.load(name, version)
    threshold = DEFAULT_THRESHOLD
    if use_registered_threshold:
        threshold = float(registry.info(name, version)["metadata"].get("threshold", threshold))
    return Scorer(prep, model, threshold)


def stream_scores(stream: DataFrame, scorer: Scorer, keep: Iterable[str], out: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """One projection per row, as in batch; no state."""
    return start_append(score_service(stream, scorer, keep), out, checkpoint, trigger)


def stream_reload(stream: DataFrame, registry: ModelRegistry, name: str, keep: Iterable[str], out: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch is scored by the version that is newest when it starts; the rows carry that version."""
    keep = list(keep)

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        version = registry.info(name)["version"]
        return score_service(batch, scorer_of(registry, name, version), keep).withColumn("model_version", F.lit(version))

    return start_batches(stream, process, out, checkpoint, trigger)
