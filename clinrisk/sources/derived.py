"""Patient, request, prediction and model-version tables that Spark derives from the generic business tables.

The definitions are in FIXTURES.md. All are row-local projections of one table (``orders`` or ``events``): integer
arithmetic on the key, no shuffle, and as many rows as the source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.functions.features import cardiac_risk_score
from clinrisk.schema import PATIENT_COLUMNS, REQUEST_COLUMNS

# Patient fields from a key; {k} stands for the key expression.
PATIENT_FIELDS = {
    "age": "CAST(29 + ({k} * 37 + 11) % 49 AS INT)",
    "sex": "CAST(CASE WHEN ({k} * 13 + 5) % 3 > 0 THEN 1 ELSE 0 END AS INT)",
    "cp": "CAST(({k} * 29 + {k} DIV 7) % 4 AS INT)",
    "trestbps": "CAST(94 + ({k} * 53 + 17) % 107 AS INT)",
    "chol": "CAST(126 + ({k} * 71 + 29) % 300 AS INT)",
    "fbs": "CAST(CASE WHEN ({k} * 19 + 3) % 7 = 0 THEN 1 ELSE 0 END AS INT)",
    "restecg": "CAST(({k} * 23 + {k} DIV 5) % 3 AS INT)",
    "thalach": "CAST(202 - ({k} * 59 + 31) % 132 AS INT)",
    "exang": "CAST(CASE WHEN ({k} * 17 + {k} DIV 11) % 3 = 0 THEN 1 ELSE 0 END AS INT)",
    "oldpeak": "CAST(({k} * 41 + 19) % 63 AS DOUBLE) / 10.0",
    "slope": "CAST(({k} * 31 + {k} DIV 13) % 3 AS INT)",
    "ca": "CAST(CASE WHEN ({k} * 43 + {k} DIV 17) % 9 < 5 THEN 0 ELSE ({k} * 43 + {k} DIV 17) % 9 - 4 END AS INT)",
    "thal": "CAST(({k} * 47 + {k} DIV 19) % 4 AS INT)",
}
# Faults put into some rows; {k} is the key, {v} the clean value.
PATIENT_FAULTS = {
    "age": "CASE WHEN {k} % 97 = 0 THEN NULL ELSE {v} END",
    "sex": "CASE WHEN {k} % 389 = 0 THEN 2 ELSE {v} END",
    "trestbps": "CASE WHEN {k} % 307 = 0 THEN -5 ELSE {v} END",
    "chol": "CASE WHEN {k} % 211 = 0 THEN 700 WHEN {k} % 101 = 0 THEN NULL ELSE {v} END",
    "oldpeak": "CASE WHEN {k} % 401 = 0 THEN CAST(20 AS DOUBLE) ELSE {v} END",
    "thal": "CASE WHEN {k} % 503 = 0 THEN NULL ELSE {v} END",
}
TARGET_NOISE = "(patient_id * 7907 + patient_id DIV 3) % 9"
TARGET_CUT = 10

PREDICTION_FIELDS = {
    "request_id": "event_id",
    "model": "CASE WHEN user_id % 3 = 0 THEN 'challenger' ELSE 'champion' END",
    "ts": "ts",
    "patient_id": "user_id",
    "probability": "CAST((event_id * 7919 + 13) % 1001 AS DOUBLE) / 1000.0",
    "prediction": "CAST(CASE WHEN (event_id * 7919 + 13) % 1001 >= 500 THEN 1 ELSE 0 END AS INT)",
    "y_true": "CAST(CASE WHEN (event_id * 7919 + 13) % 1001 + (event_id * 6007 + 11) % 1001 >= 1001"
              " THEN 1 ELSE 0 END AS INT)",
    "latency_s": "CAST((event_id * 104729 + 7) % 1500 AS DOUBLE) / 1000.0",
    "method": "CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END",
    "endpoint": "CASE WHEN event_type = 'view' THEN '/model-info' WHEN event_type = 'purchase' THEN '/predict/batch'"
                " ELSE '/predict' END",
    "status": "CAST(CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 500"
              " WHEN event_id % 50 = 0 THEN 422 ELSE 200 END AS INT)",
    "instance": "CONCAT('node-', CAST(user_id % 4 AS STRING))",
    "batch_id": "event_id DIV 20",
}

VERSION_FIELDS = {
    "model": "CONCAT('model_', CAST(o_custkey % 97 AS STRING))",
    "version": "CONCAT(CAST(1 + o_orderkey DIV 10000 AS STRING), '.', CAST(o_orderkey DIV 100 % 100 AS STRING), '.',"
               " CAST(o_orderkey % 100 AS STRING))",
    "created_at": "o_orderdate",
    "accuracy": "CAST((o_orderkey * 7919 + 13) % 1001 AS DOUBLE) / 1000.0",
    "roc_auc": "CAST((o_orderkey * 6007 + 11) % 1001 AS DOUBLE) / 1000.0",
    "threshold": "CAST(10 + o_orderkey % 80 AS DOUBLE) / 100.0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``patient_id`` and the 14 patient columns."""
    fields = [f"{e.format(k='o_orderkey')} AS {c}" for c, e in PATIENT_FIELDS.items()]
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS patient_id", *fields)
    target = (cardiac_risk_score(F.col) + F.expr(TARGET_NOISE) >= TARGET_CUT).cast("int")
    return df.withColumn("target", target)


def with_faults(df: DataFrame) -> DataFrame:
    fields = [
        f"{PATIENT_FAULTS[c].format(k='patient_id', v=c)} AS {c}" if c in PATIENT_FAULTS else c for c in PATIENT_COLUMNS
    ]
    return df.selectExpr("patient_id", *fields)


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``patients`` with nulls and rule violations."""
    return with_faults(patients(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a served prediction with its true label, latency and request labels."""
    return predictions_of(table(spark, sf_dir, "events"))


def predictions_of(events: DataFrame) -> DataFrame:
    """The same projection over an event DataFrame, batch or streaming."""
    return events.selectExpr(*[f"{e} AS {c}" for c, e in PREDICTION_FIELDS.items()])


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(payload_id, body)``: JSON bodies of ``patients_raw``.

    Some lack ``age``, some are not JSON, some write age as ``55.0`` (a valid integer), as ``55.5`` or as ``"x"`` (invalid).
    """
    def body(columns):
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    without_age = [c for c in REQUEST_COLUMNS if c != "age"]
    return patients_raw(spark, sf_dir).select(
        F.col("patient_id").alias("payload_id"),
        F.when(F.col("patient_id") % 59 == 0, F.lit("{bad"))
        .when(F.col("patient_id") % 53 == 0, body(without_age))
        .when(F.col("patient_id") % 61 == 0, body([F.col("age").cast("double").alias("age"), *without_age]))
        .when(F.col("patient_id") % 67 == 0, body([(F.col("age") + 0.5).alias("age"), *without_age]))
        .when(F.col("patient_id") % 71 == 0, body([F.lit("x").alias("age"), *without_age]))
        .otherwise(body(REQUEST_COLUMNS)).alias("body"),
    )


# Patients per request; some requests are empty, some too large.
REQUEST_SIZE = "CASE WHEN o_orderkey % 211 = 0 THEN 0 WHEN o_orderkey % 307 = 0 THEN 101 ELSE 1 + o_orderkey % 4 END"
REQUEST_STRIDE = 128


def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``request_id`` and ``patients ARRAY<STRUCT>``, built inside the row (no grouping)."""
    key = f"(o_orderkey * {REQUEST_STRIDE} + i)"
    fields = []
    for c, e in PATIENT_FIELDS.items():
        value = e.format(k=key)
        fields.append(f"'{c}', {PATIENT_FAULTS[c].format(k=key, v=value) if c in PATIENT_FAULTS else value}")
    struct = f"named_struct({', '.join(fields)})"
    n = f"CAST({REQUEST_SIZE} AS INT)"
    empty = f"filter(array({struct.replace('+ i)', '+ 0)')}), x -> false)"
    built = f"transform(sequence(0, {n} - 1), i -> {struct})"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", f"CASE WHEN {n} = 0 THEN {empty} ELSE {built} END AS patients")


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``(model, version, created_at, path, metrics MAP, metadata MAP)``, many versions per model."""
    df = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in VERSION_FIELDS.items()])
    return df.select(
        "model", "version", "created_at",
        F.concat(F.lit("models/"), "model", F.lit("_v"), "version").alias("path"),
        F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("roc_auc"), F.col("roc_auc")).alias("metrics"),
        F.create_map(F.lit("threshold"), F.col("threshold").cast("string")).alias("metadata"),
    )
