"""Scoring of patient tables, request batches and JSON payloads by one projection of literal parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.functions import rules as R
from clinrisk.functions import scoring as S
from clinrisk.functions.features import Field, engineered_columns
from clinrisk.operators.prep import PrepParams
from clinrisk.operators.quality import validate_batches
from clinrisk.operators.train import LinearModel
from clinrisk.operators.trees import TreeModel
from clinrisk.schema import BINARY, CONTINUOUS, MAX_REQUEST_PATIENTS, REQUEST_COLUMNS, REQUEST_RULES, SCORED_RULES
from clinrisk.sources.requests import parse_requests

DEFAULT_THRESHOLD = 0.5
# Inputs whose absence makes a payload fail; a missing code only leaves its one-hot columns at 0.
NUMERIC_INPUTS = [*CONTINUOUS, *BINARY, "ca"]
# What a row that cannot be scored gets.
FAILED = {"prediction": -1, "prediction_label": "error", "probability": 0.0, "risk_level": "low", "confidence": 0.0,
          "threshold_used": 0.5}


@dataclass(frozen=True)
class Scorer:
    """Fitted preprocessing and model. Everything is a literal in the plan, so scoring moves no data."""

    prep: PrepParams
    model: LinearModel | TreeModel
    threshold: float = DEFAULT_THRESHOLD

    def probability(self, get: Field, columns: Iterable[str]) -> Column:
        """From raw patient fields; derived columns are taken from the input where it has them."""
        columns = set(columns)
        wanted = set(self.prep.spec.columns()) - columns
        derived = {n: e for n, e in engineered_columns(get, columns).items() if n in wanted}
        missing = wanted - set(derived)
        if missing:
            raise ValueError(f"Missing columns: {sorted(missing)}")
        field = lambda c: derived[c] if c in derived else get(c)
        if isinstance(self.model, TreeModel):
            absent = reduce(or_, [field(c).isNull() for c in [*self.prep.spec.continuous, *self.prep.spec.binary]], F.lit(False))
            return F.when(~absent, self.model.probability(self.prep.feature_columns(field)))
        margin = self.margin(field)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def margin(self, get: Field) -> Column:
        """Intercept plus one term per input column, the scaling folded into the coefficients.

        A scaled column costs one product and a coded column one CASE, so the generated code stays small enough to be
        compiled. The value is that of the feature columns times the coefficients.
        """
        spec, beta = self.prep.spec, dict(zip(self.model.features, self.model.coefficients))
        slopes = {c: beta[f"f_{c}"] / self.prep.scale[c] for c in spec.continuous}
        constant = self.model.intercept - sum(slopes[c] * self.prep.center[c] for c in spec.continuous)
        slopes |= {c: beta[f"f_{c}"] for c in spec.binary}
        total = F.lit(float(constant))
        for c, slope in slopes.items():
            total = total + get(c).cast("double") * F.lit(float(slope))
        for c in spec.categorical:
            levels = self.prep.categories[c][1:]
            term = F.when(get(c).isNull(), F.lit(float(beta[f"f_{c}_null"]) if None in levels else 0.0))
            for level in levels:
                if level is not None:
                    term = term.when(get(c) == F.lit(level), F.lit(float(beta[f"f_{c}_{level}"])))
            total = total + term.otherwise(F.lit(0.0))
        return total

    def response(self, p: Column) -> list[Column]:
        """Response columns from a probability, risk level left-closed."""
        pred = S.prediction(p, self.threshold)
        return [pred.alias("prediction"), S.prediction_label(pred).alias("prediction_label"), p.alias("probability"),
                S.risk_level(p).alias("risk_level"), S.confidence(p, pred).alias("confidence"),
                F.lit(self.threshold).alias("threshold_used")]


def score_proba(df: DataFrame, scorer: Scorer) -> DataFrame:
    return df.withColumn("probability", scorer.probability(F.col, df.columns))


def score_table(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Input columns kept; prediction, probability, label and right-closed risk level appended."""
    p = F.col("probability")
    return score_proba(df, scorer).withColumns({
        "prediction": S.prediction(p, scorer.threshold),
        "prediction_label": S.prediction_label(S.prediction(p, scorer.threshold)),
        "risk_level": S.risk_level(p, closed="right"),
    })


def positive_share(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("n_positive"), F.avg("prediction").alias("share"))


def score_service(df: DataFrame, scorer: Scorer, keep: Iterable[str] = ()) -> DataFrame:
    """Responses of single-patient requests, one per row."""
    scored = df.select(*keep, scorer.probability(F.col, df.columns).alias("_p"))
    return scored.select(*keep, *scorer.response(F.col("_p")))


def score_requests(df: DataFrame, scorer: Scorer, limit: int | None = MAX_REQUEST_PATIENTS) -> DataFrame:
    """Score request rows that hold ``patients ARRAY<STRUCT>``: adds ``predictions``, ``total_count``, ``high_risk_count``.

    An invalid patient gets a placeholder, the others of its request are scored; an empty or too large request is rejected
    (NULL results). All of it happens inside the row: no explode, no regrouping.
    """
    def stage1(patient: Column) -> Column:
        return F.struct(R.row_errors(lambda c: patient[c], REQUEST_RULES).alias("errors"),
                        scorer.probability(lambda c: patient[c], REQUEST_COLUMNS).alias("p"))

    def stage2(x: Column) -> Column:
        failed = F.struct(*[F.lit(v).alias(n) for n, v in FAILED.items()], x["errors"].alias("errors"))
        scored = F.struct(*scorer.response(x["p"]), x["errors"].alias("errors"))
        return F.when((F.size(x["errors"]) > 0) | x["p"].isNull(), failed).otherwise(scored)

    checked = validate_batches(df, limit)
    ok = F.col("accepted")
    scored = checked.withColumn("_stage1", F.when(ok, F.transform("patients", stage1)))
    scored = scored.withColumn("predictions", F.transform("_stage1", stage2)).drop("_stage1")
    high = F.filter("predictions", lambda x: x["risk_level"] == "high")
    return scored.withColumns({"total_count": F.when(ok, F.size("predictions")),
                               "high_risk_count": F.when(ok, F.size(high))})


def score_payloads(df: DataFrame, scorer: Scorer, body: str = "body") -> DataFrame:
    """Score JSON bodies: appends ``status`` 200 / 400 / 500, the response fields (4 decimals) and ``response`` JSON text."""
    keep = df.columns
    unusable = F.lit(False)
    for c in NUMERIC_INPUTS:
        unusable = unusable | F.col(c).isNull()
    parsed = parse_requests(df, body).select(*keep, "valid_json", "missing", "invalid", unusable.alias("unusable"),
                                             scorer.probability(F.col, REQUEST_COLUMNS).alias("_p"))
    bad, unusable = ~F.col("valid_json"), F.col("unusable")
    status = F.when(bad | (F.size("missing") > 0), 400).when(unusable, 500).otherwise(200)
    error = (F.when(bad, "Invalid JSON").when(F.size("missing") > 0, "Validation failed")
             .when(unusable, "Input has no value for a numeric field"))
    staged = parsed.select(*keep, "missing", "invalid", status.alias("status"), error.alias("error"),
                           F.when(status == 200, F.col("_p")).alias("_p"))
    details = F.concat(F.transform("missing", lambda c: F.concat(F.lit("Missing required field: "), c)),
                       F.transform("invalid", lambda c: F.concat(F.lit("Invalid value for field: "), c)))
    out = staged.select(*keep, "status", "error",
                        F.when(F.size(details) > 0, details).alias("details"), *scorer.response(F.col("_p")))
    out = out.withColumns({"probability": S.rounded(F.col("probability"), 4), "confidence": S.rounded(F.col("confidence"), 4),
                           "threshold_used": F.when(F.col("status") == 200, F.col("threshold_used"))})
    fields = ["prediction", "prediction_label", "probability", "risk_level", "confidence", "threshold_used"]
    return out.withColumn("response", F.when(F.col("status") == 200, F.to_json(F.struct(*fields)))
                          .otherwise(F.to_json(F.struct("error", "details"))))


def scored_violations(scored: DataFrame, rules=SCORED_RULES) -> DataFrame:
    """Append ``valid``: prediction, probability and confidence are present and in their domains."""
    return scored.withColumn("valid", F.size(R.row_errors(F.col, [r for r in rules if r.column in scored.columns])) == 0)
