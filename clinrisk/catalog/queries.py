"""Registered queries: every operator over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinrisk.catalog import sql as Q
from clinrisk.functions import features as X
from clinrisk.functions import scoring as S
from clinrisk.operators import (
    asof, bootstrap, eventlog, explore, metrics, monitor, prep, quality, registry, score, select, split, telemetry, train, trees,
)
from clinrisk.plans.training import SHORT, TrainConfig
from clinrisk.plans.training import train as train_plan
from clinrisk.schema import (
    CATEGORICAL, CONTINUOUS, DECODE_LABELS, DISPLAY_LABELS, PATIENT_COLUMNS, REQUEST_COLUMNS, REQUEST_RULES, TABLE_RULES,
)
from clinrisk.scratch import scratch_path
from clinrisk.sources import derived, patients, requests, splits
from clinrisk.streaming import alerts as stream_alerts
from clinrisk.streaming import monitor as stream_monitor
from clinrisk.streaming import runner
from clinrisk.streaming import scoring as stream_scoring
from clinrisk.streaming import telemetry as stream_telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def rounded(df: DataFrame, digits: int, columns: list[str] | None = None) -> DataFrame:
    columns = [f.name for f in df.schema if f.dataType.typeName() == "double"] if columns is None else columns
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r(expr: str, digits: int, alias: str) -> str:
    return f"round({expr}, {digits}) AS {alias}"


def columns_sql(names) -> str:
    return ", ".join(names)


# ------------------------------------------------------------------------------------------ sources and projections

@query("scan_patients", f"WITH {Q.PATIENTS} SELECT {columns_sql(PATIENT_COLUMNS)} FROM patients")
def scan_patients(spark, sf):
    path = scratch_path(spark, "patients-csv")
    derived.patients(spark, sf).select(PATIENT_COLUMNS).write.option("header", True).csv(path)
    df = patients.read_patients(spark, path)
    patients.validate_schema(df)
    return df


@query("scan_layouts", f"WITH {Q.PATIENTS} SELECT count(*) + count(*) FILTER (WHERE patient_id % 97 = 0) AS n_rows,"
                       " count(*) FILTER (WHERE patient_id % 97 = 0) AS n_malformed, "
                       + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in PATIENT_COLUMNS if c != "oldpeak") + " FROM patients")
def scan_layouts(spark, sf):
    """Files of one folder with two column orders, and one with lines that are too short."""
    path, df = scratch_path(spark, "layouts"), derived.patients(spark, sf)
    df.where("patient_id % 2 = 0").select(PATIENT_COLUMNS).write.option("header", True).csv(f"{path}/a")
    df.where("patient_id % 2 <> 0").select(PATIENT_COLUMNS[::-1]).write.option("header", True).csv(f"{path}/b")
    short = df.where("patient_id % 97 = 0").select(F.concat_ws(",", *PATIENT_COLUMNS[:3]).alias("value"))
    head = spark.createDataFrame([(",".join(PATIENT_COLUMNS),)], "value string")
    head.unionAll(short).coalesce(1).write.text(f"{path}/c")
    read = patients.read_patients(spark, f"{path}/*", corrupt=True)
    whole = F.col(patients.CORRUPT).isNull()
    return read.agg(F.count(F.lit(1)).alias("n_rows"), F.count(patients.CORRUPT).alias("n_malformed"), *[
        F.sum(F.when(whole, F.col(c))).cast("bigint").alias(f"{c}_sum") for c in PATIENT_COLUMNS if c != "oldpeak"])


_TYPES = {"patient_id": "bigint", **{c: "double" if c == "oldpeak" else "int" for c in PATIENT_COLUMNS}}


@query("profile_nulls", f"WITH {Q.RAW} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, {len(_TYPES)} AS n_columns,"
    f" count(*) - count({c}) AS n_missing FROM raw" for i, (c, t) in enumerate(_TYPES.items())))
def profile_nulls(spark, sf):
    return patients.profile(derived.patients_raw(spark, sf))


@query("split_roundtrip", f"WITH {Q.SPLIT} SELECT split, target, count(*) AS n, CAST(sum(patient_id) AS BIGINT) AS key_sum"
                          " FROM splits WHERE split <> 'train' GROUP BY split, target")
def split_roundtrip(spark, sf):
    path = scratch_path(spark, "splits")
    splits.save_splits(split_table(spark, sf), path)
    held_out = splits.load_splits(spark, path, "val").unionByName(splits.load_splits(spark, path, "test"))
    return held_out.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("patient_id").alias("key_sum"))


# Bodies whose age is a fraction (where there is an age) or no number.
_WRONG_AGE = ("(patient_id % 53 <> 0 AND patient_id % 61 <> 0 AND ((patient_id % 67 = 0 AND age IS NOT NULL)"
              " OR (patient_id % 67 <> 0 AND patient_id % 71 = 0)))")


def payload_sql() -> str:
    return (f"WITH {Q.RAW} SELECT patient_id AS payload_id, patient_id % 59 <> 0 AS valid_json,"
            " CASE WHEN patient_id % 59 = 0 THEN NULL WHEN patient_id % 53 = 0 THEN 'age' ELSE '' END AS missing,"
            f" CASE WHEN patient_id % 59 = 0 THEN NULL WHEN {_WRONG_AGE} THEN 'age' ELSE '' END AS invalid, "
            + ", ".join(f"CASE WHEN patient_id % 59 = 0{f' OR patient_id % 53 = 0 OR {_WRONG_AGE}' if c == 'age' else ''} THEN NULL ELSE {c} END"
                        f" AS {c}" for c in REQUEST_COLUMNS) + " FROM raw")


@query("parse_requests", payload_sql())
def parse_requests(spark, sf):
    parsed = requests.parse_requests(derived.payloads(spark, sf)).drop("body")
    return parsed.withColumns({c: F.array_join(c, ",") for c in ("missing", "invalid")})


@query("required_fields", f"WITH {Q.RAW} SELECT patient_id AS payload_id, 'Missing required field: age' AS error FROM raw"
                          " WHERE patient_id % 53 = 0 AND patient_id % 59 <> 0")
def required_fields(spark, sf):
    parsed = requests.parse_requests(derived.payloads(spark, sf))
    return parsed.select("payload_id", F.explode("missing").alias("field")).select(
        "payload_id", F.concat(F.lit("Missing required field: "), "field").alias("error"))


@query("drop_missing", f"WITH {Q.RAW} SELECT * FROM raw WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in PATIENT_COLUMNS))
def drop_missing(spark, sf):
    return quality.drop_missing(derived.patients_raw(spark, sf))


# ------------------------------------------------------------------------------------------ quality

@query("missing_values", f"WITH {Q.RAW} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM raw" for c in PATIENT_COLUMNS)
    + ") WHERE n_missing > 0")
def missing_values(spark, sf):
    return quality.missing_values(derived.patients_raw(spark, sf))


def _iqr_sql(table: str, columns: list[str], k: float = 1.5) -> tuple[str, str]:
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in columns)
    masks = ", ".join(
        f"coalesce({c} < a_{c} - {k} * (b_{c} - a_{c}) OR {c} > b_{c} + {k} * (b_{c} - a_{c}), false) AS {c}_outlier"
        for c in columns)
    return f"(SELECT {stats} FROM {table}) s", masks


_IQR, _IQR_MASKS = _iqr_sql("raw", CONTINUOUS)


@query("outliers_iqr", f"WITH {Q.RAW} SELECT patient_id, {_IQR_MASKS} FROM raw, {_IQR}")
def outliers_iqr(spark, sf):
    marked = quality.detect_outliers(derived.patients_raw(spark, sf))
    return marked.select("patient_id", *[f"{c}_outlier" for c in CONTINUOUS])


@query("outliers_zscore", f"WITH {Q.RAW} SELECT patient_id, " + ", ".join(
    f"coalesce(abs(({c} - m_{c}) / s_{c}) > 2.5, false) AS {c}_outlier" for c in CONTINUOUS) + " FROM raw, (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in CONTINUOUS) + " FROM raw) s")
def outliers_zscore(spark, sf):
    marked = quality.detect_outliers(derived.patients_raw(spark, sf), method="zscore", threshold=2.5)
    return marked.select("patient_id", *[f"{c}_outlier" for c in CONTINUOUS])


@query("outlier_rows", f"WITH {Q.RAW} SELECT count(*) AS n_rows, count(*) FILTER (WHERE "
       + " OR ".join(f"{c}_outlier" for c in CONTINUOUS) + f") AS n_outlier_rows FROM (SELECT {_IQR_MASKS} FROM raw, {_IQR})")
def outlier_rows(spark, sf):
    return quality.outlier_rows(derived.patients_raw(spark, sf))


_PRICE, _PRICE_MASK = _iqr_sql("lineitem", ["l_extendedprice"], 0.5)


@query("outliers_iqr_lineitem", f"SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_extendedprice_outlier) AS n_outliers"
       f" FROM (SELECT l_returnflag, {_PRICE_MASK} FROM lineitem, {_PRICE}) GROUP BY l_returnflag")
def outliers_iqr_lineitem(spark, sf):
    marked = quality.detect_outliers(derived.table(spark, sf, "lineitem"), ["l_extendedprice"], threshold=0.5)
    return marked.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("l_extendedprice_outlier").alias("n_outliers"))


def _violations_sql() -> str:
    parts = []
    for rule in TABLE_RULES:
        c = rule.column
        if rule.values is not None:
            text = "[" + ", ".join(map(str, rule.values)) + "]"
            bad = f"count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({', '.join(map(str, rule.values))}))"
            parts.append(f"SELECT '{c}' AS \"column\", 'values' AS rule, '{text}' AS expected, {bad} AS n_violations FROM raw")
        for kind, bound, op in (("min", rule.min, "<"), ("max", rule.max, ">")):
            if bound is not None:
                parts.append(f"SELECT '{c}', '{kind}', '{bound}', count(*) FILTER (WHERE {c} {op} {bound}) FROM raw")
    parts.sort(key=lambda p: "AS rule" not in p)
    return f"WITH {Q.RAW} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_violations > 0"


@query("range_violations", _violations_sql())
def range_violations(spark, sf):
    return quality.range_violations(derived.patients_raw(spark, sf))


@query("range_bad_values", f"WITH {Q.RAW} " + " UNION ALL ".join(
    f"SELECT '{rule.column}' AS \"column\", CAST({rule.column} AS VARCHAR) AS value, count(*) AS n FROM raw WHERE"
    f" {rule.column} IS NULL OR {rule.column} NOT IN ({', '.join(map(str, rule.values))}) GROUP BY {rule.column}"
    for rule in TABLE_RULES if rule.values is not None))
def range_bad_values(spark, sf):
    return quality.bad_values(derived.patients_raw(spark, sf))


def _request_errors_sql(rules=REQUEST_RULES) -> str:
    parts = []
    for rule in rules:
        c = rule.column
        cases = f"WHEN {c} IS NULL THEN '{c}: field required'"
        if rule.values is not None:
            listed = ", ".join(map(str, rule.values))
            cases += f" WHEN {c} NOT IN ({listed}) THEN '{c}: must be one of [{listed}]'"
        if rule.min is not None:
            cases += f" WHEN {c} < {rule.min} THEN '{c}: must be at least {rule.min}'"
        if rule.max is not None:
            cases += f" WHEN {c} > {rule.max} THEN '{c}: must be at most {rule.max}'"
        parts.append(f"CASE {cases} END")
    return f"[x FOR x IN [{', '.join(parts)}] IF x IS NOT NULL]"


@query("validate_requests", f"WITH {Q.RAW} SELECT patient_id, len(errors) = 0 AS accepted, array_to_string(errors, '; ') AS errors"
       f" FROM (SELECT patient_id, {_request_errors_sql()} AS errors FROM raw)")
def validate_requests(spark, sf):
    checked = quality.validate_requests(derived.patients_raw(spark, sf))
    return checked.select("patient_id", "accepted", F.array_join("errors", "; ").alias("errors"))


@query("validate_batches", f"WITH {Q.REQUEST_SIZES} SELECT request_id, n AS n_patients, n BETWEEN 1 AND 100 AS accepted FROM request_sizes")
def validate_batches(spark, sf):
    return quality.validate_batches(derived.batch_requests(spark, sf)).drop("patients")


@query("error_events", f"WITH {Q.RAW} SELECT patient_id, 'error' AS event_type, 'validation_error' AS error_type,"
       f" unnest({_request_errors_sql()}) AS error_message FROM raw")
def error_events(spark, sf):
    return eventlog.error_events(quality.validate_requests(derived.patients_raw(spark, sf)), "patient_id")


# ------------------------------------------------------------------------------------------ features

def _feature(name: str, sql_expr: str, column, source: str = "raw", inputs: str = ""):
    table = {"raw": Q.RAW, "patients": Q.PATIENTS}[source]

    def run(spark, sf):
        df = derived.patients_raw(spark, sf) if source == "raw" else derived.patients(spark, sf)
        return df.select("patient_id", column().alias(name))

    return f"WITH {table} SELECT patient_id, {sql_expr} AS {name} FROM {source}", run


for _key, _name, _sql, _column in [
    ("age_groups", "age_group", Q.AGE_GROUP, lambda: X.age_group(F.col("age"))),
    ("bp_category", "bp_category", Q.BP_CATEGORY, lambda: X.bp_category(F.col("trestbps"))),
    ("chol_risk", "cholesterol_risk", Q.CHOL_RISK, lambda: X.cholesterol_risk(F.col("chol"))),
    ("hr_reserve", "heart_rate_reserve", "220 - age - thalach", lambda: X.heart_rate_reserve(F.col("age"), F.col("thalach"))),
    ("st_risk", "st_risk_score", "oldpeak * (slope + 1)", lambda: X.st_risk_score(F.col("oldpeak"), F.col("slope"))),
    ("risk_score", "cardiac_risk_score", f"CAST({Q.RISK_SCORE} AS INT)", lambda: X.cardiac_risk_score(F.col)),
]:
    _oracle, _run = _feature(_name, _sql, _column)
    query(_key, _oracle)(_run)


@query("interactions", f"WITH {Q.RAW} SELECT patient_id, age * thalach AS age_x_thalach, oldpeak * slope AS oldpeak_x_slope,"
                       " cp * exang AS cp_x_exang FROM raw")
def interactions(spark, sf):
    return X.add_interactions(derived.patients_raw(spark, sf)).select("patient_id", "age_x_thalach", "oldpeak_x_slope", "cp_x_exang")


@query("engineer_features", f"WITH {Q.ENGINEERED} SELECT * FROM eng")
def engineer_features(spark, sf):
    return X.engineer_features(derived.patients(spark, sf))


@query("risk_by_age_group", f"WITH {Q.ENGINEERED} SELECT age_group, count(*) AS n, round(avg(cardiac_risk_score), 9) AS mean_score,"
                            " round(avg(target), 9) AS positive_rate FROM eng GROUP BY age_group")
def risk_by_age_group(spark, sf):
    df = X.engineer_features(derived.patients(spark, sf))
    return df.groupBy("age_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("cardiac_risk_score"), 9).alias("mean_score"),
        F.round(F.avg("target"), 9).alias("positive_rate"))


@query("risk_level", f"WITH {Q.PREDICTIONS} SELECT request_id, {Q.RISK_LEVEL} AS risk_level FROM predictions")
def risk_level(spark, sf):
    return derived.predictions(spark, sf).select("request_id", S.risk_level(F.col("probability")).alias("risk_level"))


@query("risk_level_batch", f"WITH {Q.PREDICTIONS} SELECT request_id, CASE WHEN probability > 0 AND probability <= 0.3 THEN 'low'"
       " WHEN probability > 0.3 AND probability <= 0.7 THEN 'medium' WHEN probability > 0.7 AND probability <= 1 THEN 'high' END"
       " AS risk_level FROM predictions")
def risk_level_batch(spark, sf):
    return derived.predictions(spark, sf).select(
        "request_id", S.risk_level(F.col("probability"), closed="right").alias("risk_level"))


@query("round_output", f"WITH {Q.PREDICTIONS} SELECT request_id, CASE WHEN prediction = 1 THEN 'heart_disease' ELSE 'healthy' END"
       " AS prediction_label, round(probability, 4) AS probability, round(CASE WHEN prediction = 1 THEN probability ELSE"
       " 1.0 - probability END, 4) AS confidence, round(latency_s * 1000, 2) AS latency_ms FROM predictions")
def round_output(spark, sf):
    p, pred = F.col("probability"), F.col("prediction")
    return derived.predictions(spark, sf).select(
        "request_id", S.prediction_label(pred).alias("prediction_label"), S.rounded(p, 4).alias("probability"),
        S.rounded(S.confidence(p, pred), 4).alias("confidence"), S.rounded(F.col("latency_s") * 1000, 2).alias("latency_ms"))


def _factor_sql(factor: str, cases: list[tuple[str, str, str, str]]) -> str:
    def pick(i: int) -> str:
        whens = " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases[:-1])
        return f"CASE {whens} ELSE {cases[-1][i]} END"
    return (f"SELECT patient_id, '{factor}' AS factor, {pick(1)} AS level, {pick(2)} AS title, {pick(3)} AS detail FROM raw")


def _bp_text(stage: str) -> str:
    return f"'BP: ' || coalesce(CAST(trestbps AS VARCHAR), 'unknown') || ' mmHg{stage}'"


_CHOL_TEXT = "'Cholesterol: ' || coalesce(CAST(chol AS VARCHAR), 'unknown') || ' mg/dl'"
_ST_TEXT = "'Oldpeak: ' || CAST(oldpeak AS VARCHAR)"


@query("risk_factors", f"WITH {Q.RAW} " + " UNION ALL ".join([
    _factor_sql("age", [("age > 55", "'red'", "'Age > 55 years'", "'Higher risk with advancing age'"),
                        ("", "'green'", "'Age ≤ 55 years'", "'Lower age-related risk'")]),
    _factor_sql("blood_pressure", [
        ("trestbps >= 140", "'red'", "'High Blood Pressure'", _bp_text(" (Stage 2 Hypertension)")),
        ("trestbps >= 130", "'amber'", "'Elevated Blood Pressure'", _bp_text(" (Stage 1 Hypertension)")),
        ("", "'green'", "'Normal Blood Pressure'", _bp_text(""))]),
    _factor_sql("cholesterol", [("chol >= 240", "'red'", "'High Cholesterol'", _CHOL_TEXT),
                                ("chol >= 200", "'amber'", "'Borderline Cholesterol'", _CHOL_TEXT),
                                ("", "'green'", "'Healthy Cholesterol'", _CHOL_TEXT)]),
    _factor_sql("exercise_angina", [("exang = 1", "'red'", "'Exercise-Induced Angina'", "'Chest pain during physical activity'"),
                                    ("", "'green'", "'No Exercise Angina'", "'No chest pain during activity'")]),
    _factor_sql("st_depression", [("oldpeak > 2", "'red'", "'Significant ST Depression'", _ST_TEXT),
                                  ("oldpeak > 1", "'amber'", "'Moderate ST Depression'", _ST_TEXT),
                                  ("", "'green'", "'Minimal ST Depression'", _ST_TEXT)])]))
def risk_factors(spark, sf):
    return derived.patients_raw(spark, sf).select("patient_id", F.inline(X.risk_factors(F.col)))


def _decode_case(c: str, labels: dict) -> str:
    return f"CASE {' '.join(f'WHEN {c} = {k} THEN {chr(39)}{v}{chr(39)}' for k, v in labels.items())} END"


@query("decode_labels", f"WITH {Q.RAW} SELECT patient_id, " + ", ".join(
    f"{_decode_case(c, t)} AS {c}_label" for c, t in DECODE_LABELS.items()) + " FROM raw")
def decode_labels(spark, sf):
    decoded = X.decode_labels(derived.patients_raw(spark, sf))
    return decoded.select("patient_id", *[f"{c}_label" for c in DECODE_LABELS])


@query("encode_labels", f"WITH {Q.RAW} SELECT patient_id, " + ", ".join(
    f"CASE WHEN {c} < {len(v)} THEN {c} END AS {c}" for c, v in DISPLAY_LABELS.items()) + " FROM raw")
def encode_labels(spark, sf):
    names = {c: dict(enumerate(v)) for c, v in DISPLAY_LABELS.items()}
    shown = X.decode_labels(derived.patients_raw(spark, sf), names).select(
        "patient_id", *[F.col(f"{c}_label").alias(c) for c in names])
    return X.encode_labels(shown)


# ------------------------------------------------------------------------------------------ split and preprocessing

def split_table(spark, sf) -> DataFrame:
    return split.stratified_split(X.engineer_features(derived.patients(spark, sf)), "patient_id")


@query("split_stratified", f"WITH {Q.SPLIT} SELECT patient_id, target, split FROM splits")
def split_stratified(spark, sf):
    return split.stratified_split(derived.patients(spark, sf), "patient_id").select("patient_id", "target", "split")


@query("split_balance", f"WITH {Q.SPLIT} SELECT split, count(*) AS n, round(avg(target), 9) AS positive_share FROM splits GROUP BY split")
def split_balance(spark, sf):
    df = split.stratified_split(derived.patients(spark, sf), "patient_id")
    return rounded(split.split_balance(df), 9)


@query("cv_folds", f"""WITH {Q.PATIENTS}, cnt AS (SELECT target, count(*) AS nc FROM patients GROUP BY target),
  dealt AS (SELECT target, pos % 5 AS fold, count(*) AS q FROM (SELECT target, row_number() OVER (ORDER BY target) - 1 AS pos
    FROM patients) GROUP BY target, pos % 5),
  upto AS (SELECT target, fold, sum(q) OVER (PARTITION BY target ORDER BY fold) AS hi, sum(q) OVER (PARTITION BY target ORDER BY fold)
    - q AS lo FROM dealt),
  ranked AS (SELECT patient_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('42-' || patient_id), patient_id) AS rk
    FROM patients)
  SELECT patient_id, r.target, CAST(fold AS INT) AS fold FROM ranked r JOIN upto u ON r.target = u.target AND rk > lo AND rk <= hi""")
def cv_folds(spark, sf):
    return split.stratified_folds(derived.patients(spark, sf), "patient_id").select("patient_id", "target", "fold")


def _scale_sql(source: str, key: str, columns: list[str], center: str, scale: str) -> str:
    stats = ", ".join(f"{center.format(c=c)} AS a_{c}, {scale.format(c=c)} AS b_{c}" for c in columns)
    out = ", ".join(r(f"({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END", 6, f"{c}_scaled") for c in columns)
    return f"SELECT {key}, {out} FROM {source}, (SELECT {stats} FROM {source}) s"


_SCALERS = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
    "minmax": ("CAST(min({c}) AS DOUBLE)", "CAST(max({c}) - min({c}) AS DOUBLE)"),
}


def _scale(kind: str) -> Query:
    def run(spark, sf):
        df = prep.scale_columns(derived.patients(spark, sf), CONTINUOUS, kind)
        return rounded(df.select("patient_id", *[f"{c}_scaled" for c in CONTINUOUS]), 6)
    return run


for _kind, (_center, _spread) in _SCALERS.items():
    query(f"scale_{_kind}", f"WITH {Q.PATIENTS} " + _scale_sql("patients", "patient_id", CONTINUOUS, _center, _spread))(_scale(_kind))


@query("scale_standard_part", _scale_sql("part", "p_partkey", ["p_retailprice"], *_SCALERS["standard"]))
def scale_standard_part(spark, sf):
    df = prep.scale_columns(derived.table(spark, sf, "part"), ["p_retailprice"], "standard")
    return rounded(df.select("p_partkey", "p_retailprice_scaled"), 6)


@query("onehot", f"WITH {Q.PATIENTS} SELECT patient_id, " + ", ".join(
    f"CAST({c} = {i} AS DOUBLE) AS f_{c}_{i}" for c, i in Q.ONEHOT) + " FROM patients")
def onehot(spark, sf):
    df = derived.patients(spark, sf)
    params = prep.fit_prep(df, prep.PrepSpec([], [], CATEGORICAL))
    return prep.transform(df, params, ["patient_id"])


_PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_AGE_GROUPS = ["middle", "senior", "young"]


@query("onehot_strings", f"WITH {Q.ENGINEERED} SELECT patient_id, " + ", ".join(
    [f"CAST(coalesce(age_group, '') = '{v}' AS DOUBLE) AS \"f_age_group_{v}\"" for v in _AGE_GROUPS]
    + [f"CAST(o_orderpriority = '{v}' AS DOUBLE) AS \"f_o_orderpriority_{v}\"" for v in _PRIORITIES])
    + " FROM eng JOIN orders ON o_orderkey = patient_id")
def onehot_strings(spark, sf):
    stored = derived.table(spark, sf, "orders").select(F.col("o_orderkey").alias("patient_id"), "o_orderpriority")
    df = X.engineer_features(derived.patients(spark, sf)).join(stored, "patient_id")
    params = prep.fit_prep(df, prep.PrepSpec([], [], ["age_group", "o_orderpriority"]))
    return prep.transform(df, params, ["patient_id"])


def fitted_prep(spark, sf) -> tuple[prep.PrepParams, DataFrame]:
    table = split_table(spark, sf)
    return prep.fit_prep(table.where("split = 'train'"), prep.model_spec(table.columns)), table


def _params_sql() -> str:
    parts = ["SELECT 'spec' AS kind, 'standard' AS \"column\", 0 AS position, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS dtype, 'scaler' AS stat,"
             " CAST(NULL AS DOUBLE) AS value"]
    for i, c in enumerate(Q.SCALED):
        parts.append(f"SELECT 'continuous', '{c}', {i}, NULL, NULL, 'center', round(m_{c}, 6) FROM stats")
        parts.append(f"SELECT 'continuous', '{c}', {i}, NULL, NULL, 'scale', round(s_{c}, 6) FROM stats")
    parts += [f"SELECT 'binary', '{c}', {i}, NULL, NULL, 'passthrough', NULL" for i, c in enumerate(Q.PLAIN)]
    for i, c in enumerate(Q.LEVELS):
        parts.append(f"SELECT 'categorical', '{c}', {i}, CAST({c} AS VARCHAR), 'int', 'level', CAST(row_number() OVER (ORDER BY {c}) - 1 AS DOUBLE)"
                     f" FROM (SELECT DISTINCT {c} FROM splits WHERE split = 'train')")
    return f"WITH {Q.STATS} " + " UNION ALL ".join(parts)


@query("prep_params", _params_sql())
def prep_params(spark, sf):
    params, _ = fitted_prep(spark, sf)
    path = scratch_path(spark, "prep")
    prep.save_prep(params, spark, path)
    return rounded(prep.load_prep(spark, path).to_table(spark), 6)


def _features_sql(part: str) -> str:
    out = ", ".join(r(f, 6, f) for f in Q.FEATURES)
    return f"WITH {Q.FEATURE_TABLE} SELECT patient_id, target, {out} FROM features WHERE split = '{part}'"


@query("prep_fit_transform", _features_sql("train"))
def prep_fit_transform(spark, sf):
    table = split_table(spark, sf)
    _, x = prep.fit_transform(table.where("split = 'train'"), prep.model_spec(table.columns), ["patient_id", "target"])
    return rounded(x, 6)


@query("prep_transform_test", _features_sql("test"))
def prep_transform_test(spark, sf):
    params, table = fitted_prep(spark, sf)
    return rounded(prep.transform(table.where("split = 'test'"), params, ["patient_id", "target"]), 6)


# ------------------------------------------------------------------------------------------ selection and training

def _corr_sql(source: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {source}" for a, b in pairs)


@query("corr_matrix", f"WITH {Q.RAW} " + _corr_sql("raw", CONTINUOUS))
def corr_matrix(spark, sf):
    return rounded(select.corr_matrix(derived.patients_raw(spark, sf), CONTINUOUS), 6)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix_lineitem", _corr_sql("lineitem", _MEASURES))
def corr_matrix_lineitem(spark, sf):
    return rounded(select.corr_matrix(derived.table(spark, sf, "lineitem"), _MEASURES), 6)


_NUMERIC = [c for c in [*PATIENT_COLUMNS[:-1], "heart_rate_reserve", "cardiac_risk_score", "age_x_thalach", "oldpeak_x_slope",
                        "cp_x_exang"]]


@query("corr_drop", f"WITH {Q.ENGINEERED} SELECT DISTINCT b AS feature FROM ({_corr_sql('eng', _NUMERIC)}) WHERE abs(r) > 0.6")
def corr_drop(spark, sf):
    df = X.engineer_features(derived.patients(spark, sf)).drop("patient_id", "target")
    return spark.createDataFrame([(c,) for c in select.correlated_features(df, 0.6)], "feature string")


@query("variance_select", f"WITH {Q.ENGINEERED} SELECT feature FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_pop({c}) AS v FROM eng" for c in _NUMERIC) + ") WHERE v > 0.5")
def variance_select(spark, sf):
    df = X.engineer_features(derived.patients(spark, sf)).drop("patient_id", "target")
    return spark.createDataFrame([(c,) for c in select.select_by_variance(df, 0.5)], "feature string")


def training_features(spark, sf) -> tuple[DataFrame, list[str]]:
    params, table = fitted_prep(spark, sf)
    x = prep.transform(table.where("split = 'train'"), params, ["patient_id", "target"])
    return x, params.feature_names()


def fitted_model(spark, sf, **overrides) -> train.LinearModel:
    x, names = training_features(spark, sf)
    spec = train.get_model("logistic_regression", {**train.DEFAULT_PARAMS["logistic_regression"], **overrides})
    return train.fit(x, names, "target", spec)


@query("lr_fit")
def lr_fit(spark, sf):
    return rounded(fitted_model(spark, sf).to_table(spark), 5)


@query("lr_fit_l1")
def lr_fit_l1(spark, sf):
    return rounded(fitted_model(spark, sf, penalty="l1", C=0.1).to_table(spark), 5)


_OPTIMAL = "SELECT CAST(i - 1 AS INT) AS position, name AS feature, 0.0e0 AS residual FROM (SELECT unnest([" + ", ".join(
    f"'{f}'" for f in [*Q.FEATURES, "(intercept)"]) + f"]) AS name, unnest(range(1, {len(Q.FEATURES) + 2})) AS i)"


def _residuals(spark, sf, **overrides) -> DataFrame:
    x, names = training_features(spark, sf)
    spec = train.get_model("logistic_regression", {**train.DEFAULT_PARAMS["logistic_regression"], **overrides})
    return rounded(train.optimality(x, train.fit(x, names, "target", spec), "target", spec), 6)


@query("lr_fit_optimality", _OPTIMAL)
def lr_fit_optimality(spark, sf):
    """Every coefficient of the fit meets its optimality condition."""
    return _residuals(spark, sf)


@query("lr_fit_l1_optimality", _OPTIMAL)
def lr_fit_l1_optimality(spark, sf):
    return _residuals(spark, sf, penalty="l1", C=0.1)


# ------------------------------------------------------------------------------------------ exploration

@query("impute", f"WITH {Q.RAW} SELECT patient_id, coalesce(CAST(age AS DOUBLE), (SELECT quantile_cont(age, 0.5) FROM raw)) AS age,"
                 " round(coalesce(CAST(chol AS DOUBLE), (SELECT avg(chol) FROM raw)), 9) AS chol FROM raw")
def impute(spark, sf):
    df = derived.patients_raw(spark, sf).select("patient_id", "age", "chol")
    return rounded(explore.impute(df, {**explore.fit_fill(df, ["age"]), **explore.fit_fill(df, ["chol"], "mean")}), 9, ["chol"])


@query("ordinal_codes", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS o_orderpriority_code FROM orders")
def ordinal_codes(spark, sf):
    df = derived.table(spark, sf, "orders")
    return explore.ordinal_encode(df, explore.fit_ordinal(df, ["o_orderpriority"])).select("o_orderkey", "o_orderpriority_code")


@query("histogram", """WITH b AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi FROM lineitem),
c AS (SELECT CAST(least(floor((CAST(l_quantity AS DOUBLE) - lo) / ((hi - lo) / 7)), 6) AS INT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 7), 9) AS lower, round(lo + (i + 1) * ((hi - lo) / 7), 9) AS upper, coalesce(n, 0) AS n
FROM range(7) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def histogram(spark, sf):
    return rounded(explore.histogram(derived.table(spark, sf, "lineitem"), "l_quantity", 7), 9)


def _tests_sql(c: str) -> str:
    side = "avg({c}) FILTER (target = {k}) AS m{k}, var_samp({c}) FILTER (target = {k}) / count({c}) FILTER (target = {k}) AS e{k}, " \
           "count({c}) FILTER (target = {k}) AS n{k}"
    return (f"SELECT '{c}' AS \"column\", round(r, 9) AS r, round((m1 - m0) / sqrt(e0 + e1), 6) AS t,"
            f" round((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 4) AS freedom FROM (SELECT corr({c}, target) AS r, "
            + side.format(c=c, k=0) + ", " + side.format(c=c, k=1) + " FROM raw)")


@query("label_tests", f"WITH {Q.RAW} " + " UNION ALL ".join(map(_tests_sql, CONTINUOUS)))
def label_tests(spark, sf):
    out = explore.label_tests(derived.patients_raw(spark, sf), CONTINUOUS, "target")
    return out.select("column", F.round("r", 9).alias("r"), F.round("t", 6).alias("t"), F.round("freedom", 4).alias("freedom"))


@query("chi_square", f"WITH {Q.RAW}, k AS (SELECT cp, target, CAST(count(*) AS DOUBLE) AS o FROM raw WHERE cp IS NOT NULL GROUP BY ALL),"
       " g AS (SELECT a.cp, b.target, a.n * b.n / (SELECT sum(o) FROM k) AS e FROM (SELECT cp, sum(o) AS n FROM k GROUP BY 1) a,"
       " (SELECT target, sum(o) AS n FROM k GROUP BY 1) b) SELECT CAST(sum(coalesce(o, 0)) AS BIGINT) AS n,"
       " round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 6) AS statistic,"
       " CAST((count(DISTINCT cp) - 1) * (count(DISTINCT target) - 1) AS BIGINT) AS freedom,"
       " round(sqrt(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) / sum(coalesce(o, 0)) / (least(count(DISTINCT cp), count(DISTINCT target)) - 1)), 9)"
       " AS cramers_v FROM g LEFT JOIN k USING (cp, target)")
def chi_square(spark, sf):
    out = explore.chi_square(derived.patients_raw(spark, sf), "cp", "target")
    return out.select("n", F.round("statistic", 6).alias("statistic"), "freedom", F.round("cramers_v", 9).alias("cramers_v"))


# ------------------------------------------------------------------------------------------ fits

# Two features and an intercept, small enough for Newton steps in SQL: penalised log-loss with balanced class weights.
_TWO = {"age10": "(age - 50) / 10.0e0", "chol50": "(chol - 240) / 50.0e0"}
_DET = "(h11 * (h22 * h00 - h20 * h20) - h12 * (h12 * h00 - h20 * h10) + h10 * (h12 * h20 - h22 * h10))"
_NEWTON = f"""{Q.PATIENTS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS pos FROM patients),
d AS (SELECT {_TWO['age10']} AS x1, {_TWO['chol50']} AS x2, CAST(target AS DOUBLE) AS y,
  CASE WHEN target = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS w FROM patients, n),
newton(step, b1, b2, b0) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, b1 - (g1 * (h22 * h00 - h20 * h20) - h12 * (g2 * h00 - h20 * g0) + h10 * (g2 * h20 - h22 * g0)) / {_DET},
    b2 - (h11 * (g2 * h00 - h20 * g0) - g1 * (h12 * h00 - h20 * h10) + h10 * (h12 * g0 - g2 * h10)) / {_DET},
    b0 - (h11 * (h22 * g0 - g2 * h20) - h12 * (h12 * g0 - g2 * h10) + g1 * (h12 * h20 - h22 * h10)) / {_DET}
  FROM newton, LATERAL (
    SELECT b1 + sum(w * (p - y) * x1) AS g1, b2 + sum(w * (p - y) * x2) AS g2, b0 + sum(w * (p - y)) AS g0,
      1 + sum(w * p * (1 - p) * x1 * x1) AS h11, 1 + sum(w * p * (1 - p) * x2 * x2) AS h22, 1 + sum(w * p * (1 - p)) AS h00,
      sum(w * p * (1 - p) * x1 * x2) AS h12, sum(w * p * (1 - p) * x1) AS h10, sum(w * p * (1 - p) * x2) AS h20
    FROM (SELECT *, 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))) AS p FROM d) q) s
  WHERE step < 15),
fitted AS (SELECT b1, b2, b0 FROM newton WHERE step = 15)"""
_FITTED_ROWS = ("rows_ AS (SELECT 0 AS position, 'age10' AS feature, b1 AS coefficient FROM fitted UNION ALL SELECT 1, 'chol50', b2 FROM fitted"
                " UNION ALL SELECT 2, '(intercept)', b0 FROM fitted)")


def two_features(spark, sf):
    df = derived.patients(spark, sf).select("target", *[F.expr(e).alias(c) for c, e in _TWO.items()])
    return df, train.fit(df, list(_TWO), "target", train.LogisticSpec(1.0, "l2", "liblinear", 100, "balanced"))


@query("lr_fit_two", f"WITH RECURSIVE {_NEWTON}, {_FITTED_ROWS} SELECT position, feature, round(coefficient, 6) AS coefficient FROM rows_")
def lr_fit_two(spark, sf):
    return rounded(two_features(spark, sf)[1].to_table(spark), 6)


@query("accuracy_two", f"WITH RECURSIVE {_NEWTON} SELECT count(*) AS n, round(avg(CASE WHEN (b1 * x1 + b2 * x2 + b0 >= 0) = (y = 1) THEN 1.0e0"
                       " ELSE 0.0e0 END), 9) AS accuracy FROM d, fitted")
def accuracy_two(spark, sf):
    df, model = two_features(spark, sf)
    return rounded(train.accuracy(df, model, "target"), 9)


@query("importances_two", f"WITH RECURSIVE {_NEWTON}, {_FITTED_ROWS} SELECT feature, round(abs(coefficient), 6) AS importance FROM rows_"
                          " WHERE position < 2")
def importances_two(spark, sf):
    return rounded(select.importances(spark, two_features(spark, sf)[1]), 6)


@query("importance_select_two", f"WITH RECURSIVE {_NEWTON}, {_FITTED_ROWS} SELECT feature FROM rows_ WHERE position < 2 AND abs(coefficient)"
                                " > 0.5 * (SELECT sum(abs(coefficient)) FROM rows_ WHERE position < 2)")
def importance_select_two(spark, sf):
    kept = select.select_by_importance(two_features(spark, sf)[1], 0.5)
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("rfe_two", f"WITH RECURSIVE {_NEWTON}, {_FITTED_ROWS} SELECT feature, CAST(rank() OVER (ORDER BY coefficient * coefficient DESC) AS INT) AS rank FROM rows_ WHERE position < 2")
def rfe_two(spark, sf):
    x, names = two_features(spark, sf)[0], list(_TWO)
    _, ranks = select.select_by_rfe(x, names, "target", train.get_model("logistic_regression"), n_features=1)
    return spark.createDataFrame(ranks, "feature string, rank int")


@query("rfe")
def rfe(spark, sf):
    x, names = training_features(spark, sf)
    _, ranks = select.select_by_rfe(x, names, "target", train.get_model("logistic_regression"))
    return spark.createDataFrame(ranks, "feature string, rank int")


@query("importance_select")
def importance_select(spark, sf):
    kept = select.select_by_importance(fitted_model(spark, sf), 0.03)
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("importances")
def importances(spark, sf):
    return rounded(select.importances(spark, fitted_model(spark, sf)), 5)


@query("grid_search")
def grid_search(spark, sf):
    x, names = training_features(spark, sf)
    search = train.grid_search(x, names, "target", "patient_id")
    return rounded(search.cv_results, 6, ["mean_score"])


@query("random_search")
def random_search(spark, sf):
    """Rungs of a search that drops two thirds of its points on growing shares of the rows."""
    x, names = training_features(spark, sf)
    return rounded(train.random_search(x, names, "target", "patient_id", n=9)[1], 6, ["mean_score"])


@query("train_plan")
def train_plan_query(spark, sf):
    """Raw patients to test metrics of the fitted model at its tuned threshold."""
    return train_plan(derived.patients_raw(spark, sf), TrainConfig()).metrics


@query("short_plan")
def short_plan(spark, sf):
    """The short job: no quality checks, the plain features, no validation, threshold 0.5."""
    return train_plan(derived.patients_raw(spark, sf).na.drop(), SHORT).metrics


# ------------------------------------------------------------------------------------------ tree ensembles

def fixed_trees(features: list[str], kind: str) -> trees.TreeModel:
    """Five trees of depth three whose splits and leaves follow from their numbers, so that SQL can state them."""
    grown = []
    for t in range(5):
        nodes = []
        for i in range(7):
            feature = features[(t * 11 + i * 5) % len(features)]
            nodes.append(trees.Node(i, 0.5, feature, ((t + 2 * i) % 5 - 2) / 4 + 0.1, 2 * i + 1, 2 * i + 2))
        nodes += [trees.Node(i, ((t * 3 + i * 7) % 11 - (0 if kind == "vote" else 5)) / 10) for i in range(7, 15)]
        grown.append(nodes)
    return trees.TreeModel(kind, features, grown, [1.0] * 5 if kind == "vote" else [0.5 + 0.1 * t for t in range(5)])


def _tree_sql(nodes: list[trees.Node], at: int = 0) -> str:
    n = nodes[at]
    if n.feature is None:
        return f"{n.value}e0"
    return f"CASE WHEN {n.feature} > {n.threshold!r}e0 THEN {_tree_sql(nodes, n.right)} ELSE {_tree_sql(nodes, n.left)} END"


def _ensemble_sql(kind: str) -> str:
    model = fixed_trees(Q.FEATURES, kind)
    total = " + ".join(f"{w!r}e0 * ({_tree_sql(t)})" for t, w in zip(model.trees, model.weights))
    p = f"({total}) / 5.0e0" if kind == "vote" else f"1.0e0 / (1.0e0 + exp(-2.0e0 * ({total})))"
    return f"WITH {Q.STATS}, f AS (SELECT patient_id, {Q.FEATURE_EXPRS} FROM eng, stats) SELECT patient_id, round({p}, 7) AS probability FROM f"


def tree_scores(spark, sf, kind: str) -> DataFrame:
    params, _ = fitted_prep(spark, sf)
    model = fixed_trees(params.feature_names(), kind)
    scored = score.score_proba(derived.patients(spark, sf), score.Scorer(params, model))
    return rounded(scored.select("patient_id", "probability"), 7)


@query("score_forest", _ensemble_sql("vote"))
def score_forest(spark, sf):
    return tree_scores(spark, sf, "vote")


@query("score_boosted", _ensemble_sql("boost"))
def score_boosted(spark, sf):
    return tree_scores(spark, sf, "boost")


def _node_rows_sql() -> str:
    """Rows and positives of every node, then the gains of splits, of the training rows."""
    def paths(nodes, at=0, path="TRUE"):
        yield at, path
        n = nodes[at]
        if n.feature is not None:
            yield from paths(nodes, n.left, f"{path} AND {n.feature} <= {n.threshold!r}e0")
            yield from paths(nodes, n.right, f"{path} AND {n.feature} > {n.threshold!r}e0")

    model = fixed_trees(Q.FEATURES, "vote")
    counted = " UNION ALL ".join(
        f"SELECT {t} AS tree, {at} AS node, {f"'{nodes[at].feature}'" if nodes[at].feature else 'NULL'} AS feature, CAST(count(*) AS DOUBLE) AS n,"
        f" CAST(coalesce(sum(target), 0) AS DOUBLE) AS pos FROM f WHERE {path}" for t, nodes in enumerate(model.trees) for at, path in paths(nodes))
    return (f"WITH {Q.FEATURE_TABLE}, f AS (SELECT * FROM features WHERE split = 'train'), c AS ({counted}),"
            " g AS (SELECT *, CASE WHEN n > 0 THEN 2 * pos / n * (1 - pos / n) ELSE 0 END AS gini FROM c),"
            " s AS (SELECT p.tree, p.node, p.feature, p.n, p.gini - (l.n * l.gini + r.n * r.gini) / p.n AS gain FROM g p"
            " JOIN g l ON l.tree = p.tree AND l.node = 2 * p.node + 1 JOIN g r ON r.tree = p.tree AND r.node = 2 * p.node + 2 WHERE p.n > 0)")


@query("forest_importances", _node_rows_sql() + f""", w AS (SELECT tree, feature, sum(gain * n) AS g FROM s GROUP BY tree, feature),
u AS (SELECT feature, sum(g / t) AS v FROM w JOIN (SELECT tree, sum(g) AS t FROM w GROUP BY tree) USING (tree) GROUP BY feature)
SELECT name AS feature, round(coalesce(v / (SELECT sum(v) FROM u), 0), 9) AS importance
FROM (SELECT unnest([{", ".join(f"'{f}'" for f in Q.FEATURES)}]) AS name) LEFT JOIN u ON feature = name""")
def forest_importances(spark, sf):
    """Importances of fixed splits on the training rows."""
    x, names = training_features(spark, sf)
    model = trees.refreshed(x, fixed_trees(names, "vote"), "target")
    return rounded(select.importances(spark, model), 9)


@query("forest_nodes", _node_rows_sql() + " SELECT tree, node, CAST(n AS BIGINT) AS n, round(gain, 9) AS gain FROM s")
def forest_nodes(spark, sf):
    x, names = training_features(spark, sf)
    table = trees.refreshed(x, fixed_trees(names, "vote"), "target").to_table(spark)
    return table.where("kind = 'vote' AND left IS NOT NULL AND n > 0").select("tree", "node", F.col("n").cast("long").alias("n"), F.round("gain", 9).alias("gain"))


@query("forest_fit")
def forest_fit(spark, sf):
    """Node table of a forest grown on the training rows."""
    x, names = training_features(spark, sf)
    model = train.fit(x, names, "target", train.get_model("random_forest", {"n_estimators": 10, "max_depth": 5, "class_weight": "balanced"}))
    return model.to_table(spark)


@query("boosted_plan")
def boosted_plan(spark, sf):
    """Raw patients to test metrics of boosted trees at their tuned threshold."""
    return train_plan(derived.patients_raw(spark, sf), TrainConfig(model_name="gradient_boosting", model_params={"n_estimators": 10, "max_depth": 3})).metrics


# ------------------------------------------------------------------------------------------ scoring

def fixed_scorer(spark, sf) -> score.Scorer:
    params, _ = fitted_prep(spark, sf)
    names = params.feature_names()
    return score.Scorer(params, train.LinearModel(names, [Q.COEFFICIENTS.get(f, 0.0) for f in names], Q.INTERCEPT))


_SCORED = f"scored AS ({Q.scored_from('patients', '*')})"
_PRED = "CAST(probability >= 0.5 AS INT)"
_LABEL = "CASE WHEN probability >= 0.5 THEN 'heart_disease' ELSE 'healthy' END"
_CONFIDENCE = "CASE WHEN probability >= 0.5 THEN probability ELSE 1.0 - probability END"


@query("score_proba", f"WITH {Q.STATS}, {_SCORED} SELECT patient_id, round(probability, 7) AS probability FROM scored")
def score_proba(spark, sf):
    df = score.score_proba(derived.patients(spark, sf), fixed_scorer(spark, sf))
    return rounded(df.select("patient_id", "probability"), 7)


@query("score_batch", f"WITH {Q.STATS}, {_SCORED} SELECT {columns_sql(['patient_id', *PATIENT_COLUMNS])},"
       f" round(probability, 7) AS probability, {_PRED} AS prediction, {_LABEL} AS prediction_label,"
       " CASE WHEN probability > 0.7 THEN 'high' WHEN probability > 0.3 THEN 'medium' WHEN probability > 0 THEN 'low' END AS risk_level"
       " FROM scored")
def score_batch(spark, sf):
    return rounded(score.score_table(derived.patients(spark, sf), fixed_scorer(spark, sf)), 7, ["probability"])


@query("score_positive_share", f"WITH {Q.STATS}, {_SCORED} SELECT count(*) AS n, CAST(sum({_PRED}) AS BIGINT) AS n_positive,"
       f" round(avg({_PRED}), 9) AS share FROM scored")
def score_positive_share(spark, sf):
    return rounded(score.positive_share(score.score_table(derived.patients(spark, sf), fixed_scorer(spark, sf))), 9)


_SERVICE = (f"SELECT patient_id, {_PRED} AS prediction, {_LABEL} AS prediction_label, round(probability, 7) AS probability,"
            f" {Q.RISK_LEVEL} AS risk_level, round({_CONFIDENCE}, 7) AS confidence, 0.5e0 AS threshold_used FROM scored")


@query("score_service", f"WITH {Q.STATS}, {_SCORED} {_SERVICE}")
def score_service(spark, sf):
    return rounded(score.score_service(derived.patients(spark, sf), fixed_scorer(spark, sf), ["patient_id"]), 7,
                   ["probability", "confidence"])


@query("validate_scored", f"WITH {Q.STATS}, raw AS (SELECT patient_id, "
       + ", ".join(f"{Q.faulty(c, 'patient_id', c)} AS {c}" for c in PATIENT_COLUMNS)
       + f" FROM patients), scored AS ({Q.scored_from('raw', '*')}) SELECT probability IS NOT NULL AS valid, count(*) AS n FROM scored"
       " GROUP BY probability IS NOT NULL")
def validate_scored(spark, sf):
    scored = score.score_service(derived.patients_raw(spark, sf), fixed_scorer(spark, sf), ["patient_id"])
    return score.scored_violations(scored).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


_REQUESTS = (f"WITH {Q.STATS}, {Q.REQUEST_SIZES}, {Q.REQUEST_ROWS}, scored AS ("
             + Q.scored_from("request_rows", f"request_id, i, n, {_request_errors_sql()} AS errors") + ")")


@query("score_requests", _REQUESTS + ", per AS (SELECT request_id, CAST(count(*) AS INT) AS total_count,"
       " CAST(count(*) FILTER (WHERE len(errors) = 0 AND probability >= 0.7) AS INT) AS high_risk_count,"
       " string_agg(CASE WHEN len(errors) > 0 THEN '-1' WHEN probability >= 0.5 THEN '1' ELSE '0' END, ',' ORDER BY i) AS predictions,"
       " round(sum(CASE WHEN len(errors) > 0 THEN 0 ELSE probability END), 6) AS probability_sum"
       " FROM scored WHERE n BETWEEN 1 AND 100 GROUP BY request_id)"
       " SELECT z.request_id, n AS n_patients, n BETWEEN 1 AND 100 AS accepted, total_count, high_risk_count, predictions,"
       " probability_sum FROM request_sizes z LEFT JOIN per USING (request_id)")
def score_requests(spark, sf):
    scored = score.score_requests(derived.batch_requests(spark, sf), fixed_scorer(spark, sf))
    total = F.aggregate("predictions", F.lit(0.0), lambda s, x: s + x["probability"])
    return scored.select(
        "request_id", "n_patients", "accepted", "total_count", "high_risk_count",
        F.array_join(F.transform("predictions", lambda x: x["prediction"].cast("string")), ",").alias("predictions"),
        F.round(total, 6).alias("probability_sum"))


_BAD_JSON, _NO_AGE = "patient_id % 59 = 0", "patient_id % 53 = 0"
_NULL_INPUT = "(" + " OR ".join(f"{c} IS NULL" for c in score.NUMERIC_INPUTS) + ")"
_OK = f"NOT ({_BAD_JSON} OR {_NO_AGE} OR {_WRONG_AGE} OR {_NULL_INPUT})"


@query("score_payloads", f"WITH {Q.STATS}, raw AS (SELECT patient_id, "
       + ", ".join(f"{Q.faulty(c, 'patient_id', c)} AS {c}" for c in PATIENT_COLUMNS)
       + f" FROM patients), scored AS ({Q.scored_from('raw', '*')}) SELECT patient_id AS payload_id,"
       f" CAST(CASE WHEN {_BAD_JSON} OR {_NO_AGE} THEN 400 WHEN {_NULL_INPUT} OR {_WRONG_AGE} THEN 500 ELSE 200 END AS INT) AS status,"
       f" CASE WHEN {_BAD_JSON} THEN 'Invalid JSON' WHEN {_NO_AGE} THEN 'Validation failed' WHEN {_NULL_INPUT} OR {_WRONG_AGE} THEN"
       " 'Input has no value for a numeric field' END AS error,"
       f" CASE WHEN {_BAD_JSON} THEN NULL WHEN {_NO_AGE} THEN 'Missing required field: age'"
       f" WHEN {_WRONG_AGE} THEN 'Invalid value for field: age' END AS details,"
       f" CASE WHEN {_OK} THEN {_PRED} END AS prediction, CASE WHEN {_OK} THEN round(probability, 4) END AS probability,"
       f" CASE WHEN {_OK} THEN {Q.RISK_LEVEL} END AS risk_level, CASE WHEN {_OK} THEN round({_CONFIDENCE}, 4) END AS confidence"
       " FROM scored")
def score_payloads(spark, sf):
    scored = score.score_payloads(derived.payloads(spark, sf), fixed_scorer(spark, sf))
    return scored.select("payload_id", "status", "error", F.array_join("details", "; ").alias("details"), "prediction",
                         "probability", "risk_level", "confidence")


# ------------------------------------------------------------------------------------------ evaluation

_COUNTS = (f"{Q.PREDICTIONS}, c AS (SELECT CAST(count(*) FILTER (WHERE y_true = 1 AND prediction = 1) AS DOUBLE) AS tp,"
           " CAST(count(*) FILTER (WHERE y_true = 0 AND prediction = 1) AS DOUBLE) AS fp,"
           " CAST(count(*) FILTER (WHERE y_true = 1 AND prediction = 0) AS DOUBLE) AS fn,"
           " CAST(count(*) FILTER (WHERE y_true = 0 AND prediction = 0) AS DOUBLE) AS tn FROM predictions)")
_AREAS = """, s AS (SELECT probability AS t, CAST(sum(y_true) AS BIGINT) AS p, CAST(sum(1 - y_true) AS BIGINT) AS q FROM predictions
  GROUP BY probability),
  pre AS (SELECT t, p, q, CAST(sum(p) OVER w AS BIGINT) AS cp, CAST(sum(q) OVER w AS BIGINT) AS cq, CAST(sum(p) OVER () AS BIGINT) AS tp_all,
    CAST(sum(q) OVER () AS BIGINT) AS tq_all FROM s WINDOW w AS (ORDER BY t DESC)),
  areas AS (SELECT sum(CAST(q AS DOUBLE) * (cp - p / 2.0)) / (max(tp_all) * CAST(max(tq_all) AS DOUBLE)) AS roc_auc,
    sum(CAST(p AS DOUBLE) * cp / (cp + cq)) / max(tp_all) AS pr_auc FROM pre)"""
_RATIOS = ("round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS \"precision\","
           " round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,"
           " round(tn / (tn + fp), 9) AS specificity, round(tn / (tn + fn), 9) AS npv")


@query("metrics_all", f"WITH {_COUNTS}{_AREAS} SELECT {_RATIOS}, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM c, areas")
def metrics_all(spark, sf):
    return rounded(metrics.all_metrics(derived.predictions(spark, sf), "y_true", "prediction", "probability"), 9)


@query("metrics_medical", f"WITH {_COUNTS}{_AREAS} SELECT round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity,"
       " round(tp / (tp + fp), 9) AS ppv, round(tn / (tn + fn), 9) AS npv, CAST(tp AS BIGINT) AS true_positives, CAST(tn AS BIGINT)"
       " AS true_negatives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives,"
       " CAST(tp + fp + fn + tn AS BIGINT) AS total_patients, round((tp + fn) / (tp + fp + fn + tn), 9) AS disease_prevalence,"
       " round(roc_auc, 9) AS roc_auc FROM c, areas")
def metrics_medical(spark, sf):
    return rounded(metrics.medical_metrics(derived.predictions(spark, sf), "y_true", "prediction", "probability"), 9)


@query("metrics_labels", """SELECT round(avg(CAST(quality = toxic AS INT)), 9) AS accuracy,
  round(coalesce(sum(quality * toxic) / nullif(sum(toxic), 0), 0), 9) AS "precision",
  round(coalesce(sum(quality * toxic) / nullif(sum(quality), 0), 0), 9) AS recall,
  round(coalesce(2 * sum(quality * toxic) / nullif(sum(quality) + sum(toxic), 0), 0), 9) AS f1,
  round(coalesce(sum((1 - quality) * (1 - toxic)) / nullif(sum(1 - quality), 0), 0), 9) AS specificity,
  round(coalesce(sum((1 - quality) * (1 - toxic)) / nullif(sum(1 - toxic), 0), 0), 9) AS npv FROM labels""")
def metrics_labels(spark, sf):
    return rounded(metrics.all_metrics(derived.table(spark, sf, "labels"), "quality", "toxic"), 9)


@query("confusion", f"WITH {_COUNTS} SELECT 'Healthy' AS actual, 'Healthy' AS predicted, CAST(tn AS BIGINT) AS n FROM c"
       " UNION ALL SELECT 'Healthy', 'Heart Disease', CAST(fp AS BIGINT) FROM c UNION ALL SELECT 'Heart Disease', 'Healthy',"
       " CAST(fn AS BIGINT) FROM c UNION ALL SELECT 'Heart Disease', 'Heart Disease', CAST(tp AS BIGINT) FROM c")
def confusion(spark, sf):
    return metrics.confusion_matrix(derived.predictions(spark, sf), "y_true", "prediction")


@query("class_report", f"""WITH {_COUNTS}, m AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fp + fn) AS g0,
  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS g1, tn + fp AS s0, tp + fn AS s1,
  tp + fp + fn + tn AS n FROM c)
  SELECT '0' AS class, round(p0, 9) AS "precision", round(r0, 9) AS recall, round(g0, 9) AS f1, CAST(s0 AS BIGINT) AS support FROM m
  UNION ALL SELECT '1', round(p1, 9), round(r1, 9), round(g1, 9), CAST(s1 AS BIGINT) FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / n, 9), CAST(n AS BIGINT) FROM m
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 9), round((r0 + r1) / 2, 9), round((g0 + g1) / 2, 9), CAST(n AS BIGINT) FROM m
  UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 9), round((r0 * s0 + r1 * s1) / n, 9),
    round((g0 * s0 + g1 * s1) / n, 9), CAST(n AS BIGINT) FROM m""")
def class_report(spark, sf):
    return rounded(metrics.class_report(derived.predictions(spark, sf), "y_true", "prediction"), 9)


@query("evaluate", f"WITH {_COUNTS}{_AREAS}, e AS (SELECT * FROM c, areas) SELECT 0.5e0 AS threshold, CAST(tp AS BIGINT) AS tp,"
       f" CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {_RATIOS}, round(roc_auc, 9) AS roc_auc,"
       " round(pr_auc, 9) AS pr_auc FROM e")
def evaluate(spark, sf):
    return rounded(metrics.evaluate(derived.predictions(spark, sf), "probability", "y_true"), 9)


@query("metrics_json", ORACLES["evaluate"])
def metrics_json(spark, sf):
    path = scratch_path(spark, "metrics")
    row = evaluate(spark, sf)
    metrics.save_metrics(row, path)
    return spark.read.schema(row.schema).json(path)


@query("roc_auc", f"WITH {Q.PREDICTIONS}{_AREAS} SELECT round(roc_auc, 9) AS roc_auc FROM areas")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(derived.predictions(spark, sf), "probability", "y_true"), 9)


@query("avg_precision", f"WITH {Q.PREDICTIONS}{_AREAS} SELECT round(pr_auc, 9) AS pr_auc FROM areas")
def avg_precision(spark, sf):
    return rounded(metrics.average_precision(derived.predictions(spark, sf), "probability", "y_true"), 9)


_REPLICATES = 60
_POISSON = " + ".join(f"CAST(u >= {x} AS INT)" for x in bootstrap.poisson_limits())


def _hash_sql(text: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT) % {bootstrap.PRIME}"


_BOOTSTRAP = f"""WITH {Q.PREDICTIONS}, k AS (SELECT probability AS s, y_true AS y, {_hash_sql("'42-' || request_id", 1)} AS h1,
  {_hash_sql("'42-' || request_id", 9)} AS h2 FROM predictions),
d AS (SELECT r, {", ".join(f"{_hash_sql(f"'42-{c}-' || r", 1)} AS {c}" for c in "abc")} FROM range(1, {_REPLICATES + 1}) t(r)),
u AS (SELECT r, s, y, (h1 * a % {bootstrap.PRIME} + h2 * b % {bootstrap.PRIME} + c) % {bootstrap.PRIME} AS u FROM k, d),
g AS (SELECT r, s, CAST(coalesce(sum(w) FILTER (y = 1), 0) AS DOUBLE) AS pos, CAST(coalesce(sum(w) FILTER (y <> 1), 0) AS DOUBLE) AS neg
  FROM (SELECT r, s, y, {_POISSON} AS w FROM u) GROUP BY r, s),
o AS (SELECT *, sum(pos) OVER (PARTITION BY r ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum FROM g),
c AS (SELECT r, sum(neg * (cum - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos) FILTER (s >= 0.5) AS tp, sum(neg) FILTER (s >= 0.5) AS fp,
  sum(pos) FILTER (s < 0.5) AS fn, sum(neg) FILTER (s < 0.5) AS tn FROM o GROUP BY r),
m AS (SELECT r, roc_auc, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
  tn / (tn + fp) AS specificity, tn / (tn + fn) AS npv FROM c)"""


@query("bootstrap_intervals", _BOOTSTRAP + " UNION ALL ".join(
    f' SELECT \'{c}\' AS metric, count("{c}") AS replicates, round(avg("{c}"), 9) AS mean, round(stddev_samp("{c}"), 9) AS std_error,'
    f' round(quantile_cont("{c}", 0.025), 9) AS lower, round(quantile_cont("{c}", 0.975), 9) AS upper FROM m' for c in bootstrap.METRICS))
def bootstrap_intervals(spark, sf):
    return rounded(bootstrap.bootstrap_intervals(derived.predictions(spark, sf), "probability", "y_true", "request_id", _REPLICATES), 9)


@query("bootstrap_replicates", _BOOTSTRAP + " SELECT r AS replicate, " + ", ".join(f'round("{c}", 9) AS {c if c != "precision" else chr(34) + c + chr(34)}' for c in bootstrap.METRICS) + " FROM m")
def bootstrap_replicates(spark, sf):
    return rounded(bootstrap.bootstrap_replicates(derived.predictions(spark, sf), "probability", "y_true", "request_id", _REPLICATES), 9)


@query("roc_curve", f"""WITH {Q.PREDICTIONS}{_AREAS}, d AS (SELECT *, lag(cp) OVER o AS cp0, lead(cp) OVER o AS cp2, lag(cq) OVER o AS cq0,
  lead(cq) OVER o AS cq2 FROM pre WINDOW o AS (ORDER BY t DESC))
  SELECT t AS threshold, round(cq / CAST(tq_all AS DOUBLE), 9) AS fpr, round(cp / CAST(tp_all AS DOUBLE), 9) AS tpr FROM d
  WHERE cp0 IS NULL OR cp2 IS NULL OR cp2 - 2 * cp + cp0 <> 0 OR cq2 - 2 * cq + cq0 <> 0
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(derived.predictions(spark, sf), "probability", "y_true"), 9, ["fpr", "tpr"])


@query("pr_curve", f"""WITH {Q.PREDICTIONS}{_AREAS} SELECT t AS threshold, round(cp / CAST(cp + cq AS DOUBLE), 9) AS "precision",
  round(cp / CAST(tp_all AS DOUBLE), 9) AS recall FROM pre UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0""")
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(derived.predictions(spark, sf), "probability", "y_true"), 9, ["precision", "recall"])


_BIN_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)[1:-1]]


@query("calibration", f"WITH {Q.PREDICTIONS} SELECT CAST(" + " + ".join(f"CAST(probability > {e!r}e0 AS INT)" for e in _BIN_EDGES)
       + " AS INT) AS bin, count(*) AS n, round(avg(probability), 9) AS mean_predicted, round(avg(y_true), 9) AS positive_fraction"
         " FROM predictions GROUP BY 1")
def calibration(spark, sf):
    return rounded(metrics.calibration(derived.predictions(spark, sf), "probability", "y_true"), 9)


_GRID = ", ".join(f"{t!r}e0" for t in metrics.threshold_grid())
_SEARCH = (f"WITH {Q.PREDICTIONS}, k AS (SELECT t, CAST(count(*) FILTER (WHERE y_true = 1 AND probability >= t) AS DOUBLE) AS tp,"
           " CAST(count(*) FILTER (WHERE y_true = 0 AND probability >= t) AS DOUBLE) AS fp,"
           " CAST(count(*) FILTER (WHERE y_true = 1 AND probability < t) AS DOUBLE) AS fn,"
           " CAST(count(*) FILTER (WHERE y_true = 0 AND probability < t) AS DOUBLE) AS tn"
           f" FROM predictions, (SELECT unnest([{_GRID}]) AS t) GROUP BY t)")
_OBJECTIVES = {
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "youden": "coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1",
}


def _search(objective: str) -> Query:
    def run(spark, sf):
        return rounded(metrics.best_threshold(derived.predictions(spark, sf), "probability", "y_true", objective), 9, ["score"])
    return run


for _objective, _expr in _OBJECTIVES.items():
    query(f"threshold_search_{_objective}", f"{_SEARCH} SELECT t AS threshold, round({_expr}, 9) AS score FROM k"
                                            f" ORDER BY {_expr} DESC, t LIMIT 1")(_search(_objective))


@query("threshold_scores", f"{_SEARCH} SELECT t AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,"
       " CAST(tn AS BIGINT) AS tn, " + ", ".join(f"round({e}, 9) AS \"{n}\"" for n, e in _OBJECTIVES.items()) + " FROM k")
def threshold_scores(spark, sf):
    return rounded(metrics.threshold_scores(derived.predictions(spark, sf), "probability", "y_true"), 9, list(_OBJECTIVES))


@query("cv_score", f"""WITH {Q.PREDICTIONS}, dealt AS (SELECT y_true, pos % 5 AS fold, count(*) AS q FROM
  (SELECT y_true, row_number() OVER (ORDER BY y_true) - 1 AS pos FROM predictions) GROUP BY y_true, pos % 5),
  upto AS (SELECT y_true, fold, sum(q) OVER (PARTITION BY y_true ORDER BY fold) AS hi,
    sum(q) OVER (PARTITION BY y_true ORDER BY fold) - q AS lo FROM dealt),
  ranked AS (SELECT request_id, probability, y_true, row_number() OVER (PARTITION BY y_true ORDER BY md5('42-' || request_id), request_id)
    AS rk FROM predictions),
  folded AS (SELECT r.*, CAST(fold AS INT) AS fold FROM ranked r JOIN upto u ON r.y_true = u.y_true AND rk > lo AND rk <= hi),
  s AS (SELECT fold, probability AS t, CAST(sum(y_true) AS DOUBLE) AS p, CAST(sum(1 - y_true) AS DOUBLE) AS q FROM folded GROUP BY fold, t),
  pre AS (SELECT fold, p, q, sum(p) OVER (PARTITION BY fold ORDER BY t DESC) AS cp FROM s)
  SELECT fold, round(sum(q * (cp - p / 2)) / (sum(p) * sum(q)), 9) AS roc_auc FROM pre GROUP BY fold""")
def cv_score(spark, sf):
    folded = split.stratified_folds(derived.predictions(spark, sf), "request_id", "y_true")
    return rounded(metrics.auc_by(folded, "probability", "y_true", ["fold"]), 9)


# ------------------------------------------------------------------------------------------ model versions

@query("latest_version", f"WITH {Q.VERSIONS} SELECT model, version, created_at, 'models/' || model || '_v' || version AS path, accuracy,"
       " roc_auc FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY major DESC, minor DESC, patch DESC) AS rn FROM versions)"
       " WHERE rn = 1")
def latest_version(spark, sf):
    latest = registry.latest_versions(derived.model_versions(spark, sf))
    return latest.select("model", "version", "created_at", "path", F.col("metrics")["accuracy"].alias("accuracy"),
                         F.col("metrics")["roc_auc"].alias("roc_auc"))


@query("versions_at", f"WITH {Q.VERSIONS}, v AS (SELECT model, created_at, max((major, minor, patch, version)) AS r FROM versions GROUP BY model, created_at),"
       " e AS (SELECT l_orderkey, l_linenumber, 'model_' || (l_partkey % 97) AS model, l_shipdate AS ts FROM lineitem)"
       " SELECT l_orderkey, l_linenumber, e.model, r[4] AS version FROM e ASOF LEFT JOIN v ON e.model = v.model AND e.ts >= v.created_at")
def versions_at(spark, sf):
    """The model version that was current when each of many requests came."""
    requests_ = derived.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("model_"), (F.col("l_partkey") % 97).cast("string")).alias("model"), F.col("l_shipdate").alias("ts"))
    return asof.versions_at(requests_, derived.model_versions(spark, sf), slot="month").drop("ts")


@query("next_version", f"WITH {Q.VERSIONS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY major DESC,"
       " minor DESC, patch DESC) AS rn FROM versions) WHERE rn = 1) SELECT model, version AS latest, major || '.' || minor || '.' ||"
       " (patch + 1) AS next FROM top")
def next_version(spark, sf):
    return registry.next_versions(derived.model_versions(spark, sf))


@query("list_versions", f"WITH {Q.VERSIONS} SELECT model, version, created_at FROM versions ORDER BY model, major, minor, patch")
def list_versions(spark, sf):
    return registry.list_versions(derived.model_versions(spark, sf)).select("model", "version", "created_at")


@query("model_history", f"WITH {Q.VERSIONS} SELECT model, version, created_at, 'accuracy' AS metric, accuracy AS value FROM versions"
                        " UNION ALL SELECT model, version, created_at, 'roc_auc', roc_auc FROM versions")
def model_history(spark, sf):
    return registry.model_history(derived.model_versions(spark, sf))


@query("model_info", f"WITH {Q.VERSIONS} SELECT model, version, accuracy, threshold FROM (SELECT *, row_number() OVER (PARTITION BY model"
                     " ORDER BY major DESC, minor DESC, patch DESC) AS rn FROM versions) WHERE rn = 1")
def model_info(spark, sf):
    info = registry.model_info(derived.model_versions(spark, sf))
    return info.select("model", "version", F.col("metrics")["accuracy"].alias("accuracy"), "threshold")


# ------------------------------------------------------------------------------------------ monitoring

_LAST = (f"{Q.PREDICTIONS}, last_n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, request_id DESC)"
         " AS rn FROM predictions) WHERE rn <= 1000)")
_STATS = ("count(*) AS total_predictions, round(avg(probability), 9) AS mean_probability, round(stddev_pop(probability), 9) AS"
          " std_probability, round(avg(prediction), 9) AS positive_rate, min(probability) AS min_probability, max(probability) AS"
          " max_probability, count(*) FILTER (WHERE probability >= 0.7) AS high_risk_count, count(*) FILTER (WHERE probability >= 0.3"
          " AND probability < 0.7) AS medium_risk_count, count(*) FILTER (WHERE probability < 0.3) AS low_risk_count")


@query("last_n_window", f"WITH {_LAST} SELECT request_id, model, ts, prediction, probability FROM last_n")
def last_n_window(spark, sf):
    return monitor.last_n(derived.predictions(spark, sf)).select("request_id", "model", "ts", "prediction", "probability")


@query("window_stats", f"WITH {_LAST} SELECT model, {_STATS} FROM last_n GROUP BY model")
def window_stats(spark, sf):
    return rounded(monitor.window_stats(monitor.last_n(derived.predictions(spark, sf))), 9)


# The reference period of the baseline: the first ten days.
BASELINE_END = "2024-01-11 00:00:00"
_BASE = (f"base AS (SELECT model, avg(probability) AS bm, stddev_pop(probability) AS bs, avg(prediction) AS br FROM predictions"
         f" WHERE ts < TIMESTAMP '{BASELINE_END}' AND model = 'champion' GROUP BY model)")


RESET_AT = datetime(2024, 1, 15)


@query("reset_window", f"WITH {Q.PREDICTIONS} SELECT model, {_STATS} FROM predictions WHERE ts >= TIMESTAMP '{RESET_AT}' GROUP BY model")
def reset_window(spark, sf):
    """Statistics of what came after monitoring was started anew."""
    return rounded(monitor.window_stats(monitor.after_reset(derived.predictions(spark, sf), RESET_AT)), 9)


def baseline_table(spark, sf) -> DataFrame:
    df = derived.predictions(spark, sf)
    first = df.where((F.col("ts") < F.lit(BASELINE_END).cast("timestamp_ntz")) & (F.col("model") == "champion"))
    return monitor.baseline(first)


@query("baseline_stats", f"WITH {Q.PREDICTIONS}, {_BASE} SELECT model, round(bm, 9) AS baseline_mean_prob, round(bs, 9) AS baseline_std_prob,"
                         " round(br, 9) AS baseline_positive_rate FROM base")
def baseline_stats(spark, sf):
    return rounded(baseline_table(spark, sf), 9)


def drift_table(spark, sf, **limits) -> DataFrame:
    stats = monitor.window_stats(monitor.last_n(derived.predictions(spark, sf)))
    return monitor.drift(stats, baseline_table(spark, sf), **limits)


_DRIFT = (f"WITH {_LAST}, {_BASE}, st AS (SELECT model, avg(probability) AS cm, avg(prediction) AS cr FROM last_n GROUP BY model),"
          " d AS (SELECT st.model, cm, cr, bm, bs, br, CASE WHEN bs > 0 THEN abs(cm - bm) / bs WHEN bm IS NOT NULL THEN 0 END AS z,"
          " abs(cr - br) AS rd FROM st LEFT JOIN base USING (model))")


@query("drift", _DRIFT + " SELECT model, CASE WHEN bm IS NULL THEN 'Baseline not set' ELSE 'ok' END AS status, round(z, 9) AS"
       " probability_drift_zscore, round(rd, 9) AS positive_rate_drift, round(cm, 9) AS current_mean_prob, round(bm, 9) AS baseline_mean_prob,"
       " round(cr, 9) AS current_positive_rate, round(br, 9) AS baseline_positive_rate, z > 2.0 OR rd > 0.1 AS drift_detected,"
       " CASE WHEN z > 2.0 OR rd > 0.1 THEN 'Investigate model performance - consider retraining' WHEN bm IS NOT NULL THEN"
       " 'No action needed' END AS recommendation FROM d")
def drift(spark, sf):
    return rounded(drift_table(spark, sf), 9)


@query("drift_events", _DRIFT + " SELECT model, 'drift_detected' AS event_type, 'probability' AS drift_type, round(z, 4) AS drift_value,"
       " 0.0001e0 AS threshold FROM d WHERE z > 0.0001 UNION ALL SELECT model, 'drift_detected', 'positive_rate', round(rd, 4), 0.00001e0"
       " FROM d WHERE rd > 0.00001")
def drift_events(spark, sf):
    limits = {"z_limit": 0.0001, "rate_limit": 0.00001}
    return eventlog.drift_events(drift_table(spark, sf, **limits), **limits)


AS_OF = "2024-01-20 12:00:00"


@query("recent_summary", f"WITH {Q.PREDICTIONS} SELECT 720 AS period_minutes, count(*) AS prediction_count, round(avg(probability), 9) AS"
       " mean_probability, count(*) FILTER (WHERE probability >= 0.7) AS high_risk_count, count(*) FILTER (WHERE probability >= 0.3 AND"
       " probability < 0.7) AS medium_risk_count, count(*) FILTER (WHERE probability < 0.3) AS low_risk_count, round(avg(prediction), 9) AS"
       f" positive_rate, 'ok' AS status FROM predictions WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 720 MINUTE")
def recent_summary(spark, sf):
    return rounded(monitor.recent_summary(derived.predictions(spark, sf), AS_OF, 720), 9)


# ------------------------------------------------------------------------------------------ telemetry

@query("slow_requests", f"WITH {Q.PREDICTIONS} SELECT request_id, method, endpoint, latency_s FROM predictions WHERE latency_s > 1.0")
def slow_requests(spark, sf):
    return telemetry.slow_requests(derived.predictions(spark, sf)).select("request_id", "method", "endpoint", "latency_s")


@query("pred_counter", f"WITH {Q.PREDICTIONS} SELECT {Q.RISK_LEVEL} AS risk_level, count(*) AS n FROM predictions GROUP BY 1")
def pred_counter(spark, sf):
    return telemetry.prediction_counter(derived.predictions(spark, sf))


@query("req_counter", f"WITH {Q.PREDICTIONS} SELECT method, endpoint, status, count(*) AS n FROM predictions GROUP BY ALL")
def req_counter(spark, sf):
    return telemetry.request_counter(derived.predictions(spark, sf))


@query("totals", f"WITH {Q.PREDICTIONS} SELECT count(*) AS total, count(*) FILTER (WHERE probability >= 0.7) AS high_risk FROM predictions")
def totals(spark, sf):
    return telemetry.totals(derived.predictions(spark, sf))


@query("latency_hist", f"WITH {Q.PREDICTIONS} " + " UNION ALL ".join(
    [f"SELECT '{b}' AS le, count(*) FILTER (WHERE latency_s <= {b}) AS n FROM predictions" for b in telemetry.LATENCY_BUCKETS]
    + ["SELECT '+Inf', count(*) FROM predictions"]))
def latency_hist(spark, sf):
    return telemetry.latency_histogram(derived.predictions(spark, sf))


HOUR = timedelta(hours=1)


@query("rate_by_risk", f"WITH {Q.PREDICTIONS} SELECT risk_level, w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n,"
       f" round(count(*) / 60.0, 9) AS rate FROM (SELECT {Q.RISK_LEVEL} AS risk_level, date_trunc('hour', ts) AS w FROM predictions)"
       " GROUP BY risk_level, w")
def rate_by_risk(spark, sf):
    df = telemetry.with_risk_level(derived.predictions(spark, sf))
    return rounded(telemetry.rates(df, ["risk_level"], HOUR), 9)


def _slide(width_hours: int) -> str:
    """Relation of (event, window_end): each event in the ``width`` one-hour-step windows that hold it."""
    return (f"(SELECT p.*, date_trunc('hour', ts) + to_hours(CAST(1 + j AS BIGINT)) AS window_end FROM predictions p,"
            f" (SELECT unnest(range(0, {width_hours})) AS j))")


@query("rate_by_endpoint", f"WITH {Q.PREDICTIONS} SELECT endpoint, window_end - INTERVAL 6 HOUR AS window_start, window_end, count(*) AS n,"
       f" round(count(*) / 360.0, 9) AS rate FROM {_slide(6)} GROUP BY endpoint, window_end")
def rate_by_endpoint(spark, sf):
    return rounded(telemetry.rates(derived.predictions(spark, sf), ["endpoint"], 6 * HOUR, HOUR), 9)


@query("counter_rollup", f"WITH {Q.PREDICTIONS}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM predictions) SELECT day, method, endpoint, status,"
       " CAST(GROUPING(day, method, endpoint, status) AS BIGINT) AS level, count(*) AS n FROM d GROUP BY GROUPING SETS ((day, method, endpoint, status),"
       " (day, method, endpoint), (day, method), (day), (method), (endpoint), (status), ())")
def counter_rollup(spark, sf):
    return telemetry.counter_rollup(derived.predictions(spark, sf))


_GROWTH = 1.01 / 0.99
_SKETCH_QUANTILES = (0.5, 0.95, 0.99)


@query("sketch_quantiles", f"WITH {Q.PREDICTIONS}, v AS (SELECT window_end, endpoint, latency_s, CASE WHEN latency_s > 0 THEN ceil(round(ln(latency_s) / {math.log(_GROWTH)!r}e0, 9)) END AS b"
       f" FROM {_slide(6)}), o AS (SELECT *, row_number() OVER (PARTITION BY window_end, endpoint ORDER BY latency_s) - 1 AS rank,"
       " count(*) OVER (PARTITION BY window_end, endpoint) AS n FROM v) SELECT endpoint, window_end, n, " + ", ".join(
           f"round(max(CASE WHEN rank = floor({q} * (n - 1)) THEN CASE WHEN b IS NULL THEN 0 ELSE 2 * pow({_GROWTH!r}e0, b) / {_GROWTH + 1!r}e0 END END), 9) AS q{round(q * 100):02d}"
           for q in _SKETCH_QUANTILES) + " FROM o GROUP BY endpoint, window_end, n")
def sketch_quantiles(spark, sf):
    sketches = telemetry.latency_sketches(derived.predictions(spark, sf), HOUR, ["endpoint"])
    return rounded(telemetry.sketch_quantiles(sketches, _SKETCH_QUANTILES, HOUR, 6 * HOUR, ["endpoint"]), 9)


def _quantile_sql(q: float) -> str:
    whens, bounds = [], telemetry.LATENCY_BUCKETS
    for i, b in enumerate(bounds):
        low, before = (0.0, "0") if i == 0 else (bounds[i - 1], f"b{i - 1}")
        whens.append(f"WHEN b{i} >= {q}e0 * n THEN {low}e0 + ({b}e0 - {low}e0) * coalesce(({q}e0 * n - {before}) / nullif(b{i} - {before}, 0), 0)")
    return f"CASE {' '.join(whens)} ELSE {bounds[-1]} END"


@query("latency_quantiles", f"WITH {Q.PREDICTIONS}, b AS (SELECT window_end, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (WHERE latency_s <= {b}) AS b{i}" for i, b in enumerate(telemetry.LATENCY_BUCKETS))
    + f" FROM {_slide(3)} GROUP BY window_end) SELECT window_end - INTERVAL 3 HOUR AS window_start, window_end, n,"
      f" round({_quantile_sql(0.5)}, 6) AS q50, round({_quantile_sql(0.95)}, 6) AS q95 FROM b")
def latency_quantiles(spark, sf):
    return rounded(telemetry.latency_quantiles(derived.predictions(spark, sf), width=3 * HOUR, step=HOUR), 6)


def _held_sql(condition: str, hold_hours: int, extra: str = "") -> str:
    return (f"WITH {Q.PREDICTIONS}, ev AS (SELECT window_end AS t, {condition} AS breach FROM {_slide(6)} GROUP BY window_end),"
            " g AS (SELECT t, t - to_hours(row_number() OVER (ORDER BY t)) AS run FROM ev WHERE breach)"
            f" SELECT min(t) AS pending_since, min(t) + INTERVAL {hold_hours} HOUR AS firing_since, max(t) AS resolved_after,"
            f" count(*) AS n_evaluations FROM g GROUP BY run HAVING max(t) - min(t) >= INTERVAL {hold_hours} HOUR")


@query("alert_error_rate", _held_sql("count(*) FILTER (WHERE status BETWEEN 500 AND 599) / CAST(count(*) AS DOUBLE) > 0.05", 6))
def alert_error_rate(spark, sf):
    return telemetry.alert_error_rate(derived.predictions(spark, sf), 6 * HOUR, HOUR, 6 * HOUR)


@query("alert_high_risk", _held_sql("count(*) FILTER (WHERE probability >= 0.7) / CAST(count(*) AS DOUBLE) > 0.31", 3))
def alert_high_risk(spark, sf):
    return telemetry.alert_high_risk(derived.predictions(spark, sf), 6 * HOUR, HOUR, 3 * HOUR, 0.31)


@query("alert_latency", _held_sql("quantile_cont(latency_s, 0.95) > 1.425", 3))
def alert_latency(spark, sf):
    return telemetry.alert_latency(derived.predictions(spark, sf), 6 * HOUR, HOUR, 3 * HOUR, 1.425)


_GAPS = "SELECT {by}ts AS last_seen, lead(ts) OVER ({part}ORDER BY ts) AS next_seen FROM predictions"


@query("alert_silence", f"WITH {Q.PREDICTIONS} SELECT last_seen + INTERVAL 30 MINUTE AS firing_since, next_seen AS resolved_at FROM ("
       + _GAPS.format(by="", part="") + ") WHERE next_seen - last_seen > INTERVAL 30 MINUTE")
def alert_silence(spark, sf):
    return telemetry.alert_silence(derived.predictions(spark, sf), timedelta(minutes=15), timedelta(minutes=15))


@query("heartbeat_gaps", f"WITH {Q.PREDICTIONS} SELECT instance, last_seen, next_seen, round((epoch_us(next_seen) - epoch_us(last_seen))"
       " / 1000000.0, 6) AS gap_seconds FROM (" + _GAPS.format(by="instance, ", part="PARTITION BY instance ")
       + ") WHERE next_seen - last_seen > INTERVAL 1 HOUR")
def heartbeat_gaps(spark, sf):
    return rounded(telemetry.heartbeat_gaps(derived.predictions(spark, sf), HOUR), 6)


# ------------------------------------------------------------------------------------------ event log

_EVENT = (f"SELECT ts, 'prediction' AS event_type, CAST(patient_id AS VARCHAR) AS patient_id, prediction, CASE WHEN prediction = 1 THEN"
          f" 'heart_disease' ELSE 'healthy' END AS prediction_label, round(probability, 4) AS probability, {Q.RISK_LEVEL} AS risk_level,"
          " round(latency_s * 1000, 2) AS latency_ms, model FROM predictions")


@query("prediction_events", f"WITH {Q.PREDICTIONS} {_EVENT}")
def prediction_events(spark, sf):
    return eventlog.prediction_events(derived.predictions(spark, sf), ["model"])


@query("batch_events", f"WITH {Q.PREDICTIONS} SELECT batch_id, max(ts) AS ts, 'batch_prediction' AS event_type, count(*) AS batch_size,"
       " count(*) FILTER (WHERE probability >= 0.7) AS high_risk_count, round(count(*) FILTER (WHERE probability >= 0.7) /"
       " CAST(count(*) AS DOUBLE), 4) AS high_risk_rate, round(sum(latency_s * 1000), 2) AS total_latency_ms,"
       " round(sum(latency_s * 1000) / count(*), 2) AS avg_latency_ms FROM predictions GROUP BY batch_id")
def batch_events(spark, sf):
    return eventlog.batch_events(derived.predictions(spark, sf))


@query("event_log_json", f"WITH {Q.PREDICTIONS} SELECT to_json({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'level': 'INFO',"
       " 'logger': 'clinrisk.predictions', 'message': 'Prediction made', 'event_type': event_type, 'patient_id': patient_id,"
       " 'prediction': prediction, 'prediction_label': prediction_label, 'probability': probability, 'risk_level': risk_level,"
       f" 'latency_ms': latency_ms, 'model': model}}) AS value FROM ({_EVENT})")
def event_log_json(spark, sf):
    events = eventlog.prediction_events(derived.predictions(spark, sf), ["model"])
    path = scratch_path(spark, "event-log")
    eventlog.write_log(eventlog.to_log_lines(events, "Prediction made"), path)
    return spark.read.text(path)


# ------------------------------------------------------------------------------------------ streams

def prediction_stream(spark, sf) -> DataFrame:
    schema = derived.table(spark, sf, "events").schema
    return derived.predictions_of(runner.read_table_stream(spark, sf, "events.parquet", schema))


@query("stream_last_n", f"WITH {_LAST} SELECT model, {_STATS} FROM last_n GROUP BY model")
def stream_last_n(spark, sf):
    state, landing = scratch_path(spark, "last-n"), scratch_path(spark, "landing")
    events = derived.table(spark, sf, "events")
    events.repartitionByRange(5, "ts").write.parquet(landing)
    files = runner.read_table_stream(spark, landing, "*.parquet", events.schema, max_files=1)
    q = runner.finish(stream_monitor.stream_last_n(derived.predictions_of(files), state, scratch_path(spark, "checkpoint")))
    return rounded(monitor.window_stats(stream_monitor.last_state(q, spark, state)), 9)


def zoneless(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# A stream emits the windows that its watermark, one hour behind the newest event, has passed.
_CLOSED = "window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM predictions)"


@query("stream_recent", f"WITH {Q.PREDICTIONS} SELECT window_end - INTERVAL 6 HOUR AS window_start, window_end, model, count(*) AS"
       " prediction_count, round(avg(probability), 12) AS mean_probability, count(*) FILTER (WHERE probability >= 0.7) AS high_risk_count,"
       " count(*) FILTER (WHERE probability >= 0.3 AND probability < 0.7) AS medium_risk_count, count(*) FILTER (WHERE probability < 0.3)"
       f" AS low_risk_count, round(avg(prediction), 12) AS positive_rate FROM {_slide(6)} WHERE {_CLOSED} GROUP BY window_end, model")
def stream_recent(spark, sf):
    out = scratch_path(spark, "recent")
    runner.finish(stream_monitor.stream_recent(prediction_stream(spark, sf), out, scratch_path(spark, "checkpoint"),
                                               minutes=360, slide=60))
    return zoneless(rounded(spark.read.parquet(out), 12))


@query("stream_rates", f"WITH {Q.PREDICTIONS}, w AS (SELECT {Q.RISK_LEVEL} AS risk_level, date_trunc('hour', ts) + INTERVAL 1 HOUR AS"
       " window_end FROM predictions) SELECT window_end - INTERVAL 1 HOUR AS window_start, window_end, risk_level, count(*) AS n,"
       f" round(count(*) / 60.0, 9) AS rate FROM w WHERE {_CLOSED} GROUP BY window_end, risk_level")
def stream_rates(spark, sf):
    out = scratch_path(spark, "rates")
    rates = stream_telemetry.stream_rates(prediction_stream(spark, sf), ["risk_level"], HOUR)
    runner.finish(runner.start_append(rates, out, scratch_path(spark, "checkpoint")))
    return zoneless(rounded(spark.read.parquet(out), 9))


def patient_stream(spark, sf) -> DataFrame:
    schema = derived.table(spark, sf, "orders").schema
    orders = runner.read_table_stream(spark, sf, "orders.parquet", schema)
    fields = [f"{e.format(k='o_orderkey')} AS {c}" for c, e in derived.PATIENT_FIELDS.items()]
    return orders.selectExpr("o_orderkey AS patient_id", *fields)


@query("stream_score", f"WITH {Q.STATS}, {_SCORED} {_SERVICE}")
def stream_score(spark, sf):
    out = scratch_path(spark, "scores")
    runner.finish(stream_scoring.stream_scores(patient_stream(spark, sf), fixed_scorer(spark, sf), ["patient_id"], out,
                                               scratch_path(spark, "checkpoint")))
    return rounded(spark.read.parquet(out), 7, ["probability", "confidence"])


_RELOADED = """r AS (SELECT * EXCLUDE (probability), CASE WHEN patient_id % 2 = 0 THEN probability
  ELSE 1.0 / (1.0 + exp(-0.5e0) * (1.0 - probability) / probability) END AS probability FROM scored)"""


@query("stream_reload", f"WITH {Q.STATS}, {_SCORED}, {_RELOADED}, s AS ({_SERVICE.replace('FROM scored', 'FROM r')}) SELECT *,"
                        " CASE WHEN patient_id % 2 = 0 THEN '1.0.0' ELSE '1.0.1' END AS model_version FROM s")
def stream_reload(spark, sf):
    """A second version is registered between two micro-batches of one stream."""
    scorer = fixed_scorer(spark, sf)
    models = registry.ModelRegistry(spark, scratch_path(spark, "registry"))
    out, checkpoint, landing = (scratch_path(spark, n) for n in ("reload", "checkpoint", "landing"))
    orders = derived.table(spark, sf, "orders")
    fields = [f"{e.format(k='o_orderkey')} AS {c}" for c, e in derived.PATIENT_FIELDS.items()]
    for part in range(2):
        model = train.LinearModel(scorer.model.features, scorer.model.coefficients, Q.INTERCEPT + 0.5 * part)
        models.register(model, scorer.prep, {}, {"model_name": "fixed"})
        orders.where(F.pmod("o_orderkey", F.lit(2)) == part).write.mode("append").parquet(landing)
        stream = runner.read_table_stream(spark, landing, "*.parquet", orders.schema).selectExpr("o_orderkey AS patient_id", *fields)
        runner.finish(stream_scoring.stream_reload(stream, models, "fixed", ["patient_id"], out, checkpoint))
    return rounded(spark.read.parquet(out).drop("batch"), 7, ["probability", "confidence"])


def in_time_order(spark, sf, parts: int = 4) -> DataFrame:
    """Predictions as a stream of files, each of later events than those before it."""
    events, landing = derived.table(spark, sf, "events"), scratch_path(spark, "landing")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(at, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000)).first()[0]
    place = sum([(at > c).cast("int") for c in cuts], F.lit(0))
    for i in range(parts):
        events.where(place == i).coalesce(1).write.mode("append").parquet(landing)
    return derived.predictions_of(runner.read_table_stream(spark, landing, "*.parquet", events.schema, max_files=1))


def times_without_zone(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


_PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM predictions)"


@query("stream_silence", f"WITH {Q.PREDICTIONS} SELECT CAST(instance AS VARCHAR) AS key, last_seen, last_seen + INTERVAL 1 HOUR AS firing_since, next_seen AS resolved_at"
       " FROM (" + _GAPS.format(by="instance, ", part="PARTITION BY instance ") + f") WHERE next_seen - last_seen > INTERVAL 1 HOUR AND next_seen <= {_PASSED}")
def stream_silence(spark, sf):
    out = scratch_path(spark, "silence")
    live = stream_alerts.stream_silence(in_time_order(spark, sf), "instance", HOUR / 2, HOUR / 2)
    runner.finish(runner.start_append(live, out, scratch_path(spark, "checkpoint")))
    return times_without_zone(spark.read.parquet(out)).where(F.col("status") == stream_alerts.RESOLVED).drop("status")


@query("stream_held", f"WITH {Q.PREDICTIONS} SELECT 'all' AS key, pending_since, firing_since, resolved_after, n_evaluations FROM ("
       + _held_sql("count(*) FILTER (WHERE probability >= 0.7) / CAST(count(*) AS DOUBLE) > 0.31", 3) + f") WHERE resolved_after + INTERVAL 1 HOUR <= {_PASSED}")
def stream_held(spark, sf):
    out = scratch_path(spark, "held")
    live = stream_alerts.stream_held(in_time_order(spark, sf), F.col("probability") >= 0.7, 0.31, 6 * HOUR, HOUR, 3 * HOUR)
    runner.finish(runner.start_append(live, out, scratch_path(spark, "checkpoint")))
    return times_without_zone(spark.read.parquet(out)).where(F.col("status") == stream_alerts.RESOLVED).drop("status")


def newest_rows(spark, out: str) -> DataFrame:
    """The row of each model's last micro-batch."""
    table = spark.read.parquet(out)
    rest = [c for c in table.columns if c not in ("model", "batch", "newest")]
    return table.groupBy("model").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("model", "s.*")


@query("stream_live_stats", ORACLES["stream_last_n"])
def stream_live_stats(spark, sf):
    out = scratch_path(spark, "live-stats")
    runner.finish(stream_monitor.stream_live_stats(in_time_order(spark, sf), out, scratch_path(spark, "checkpoint")))
    return rounded(newest_rows(spark, out), 9)


@query("stream_drift", ORACLES["drift"])
def stream_drift(spark, sf):
    out, base = scratch_path(spark, "drift"), scratch_path(spark, "baseline")
    baseline_table(spark, sf).write.parquet(base)
    runner.finish(stream_monitor.stream_drift(in_time_order(spark, sf), base, out, scratch_path(spark, "checkpoint")))
    return rounded(newest_rows(spark, out), 9)


@query("stream_sessions", f"""WITH {Q.PREDICTIONS}, b AS (SELECT instance, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY instance ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s
  FROM predictions), g AS (SELECT instance, ts, sum(s) OVER (PARTITION BY instance ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT instance, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM g GROUP BY instance, run HAVING max(ts) + INTERVAL 1 HOUR <= {_PASSED}""")
def stream_sessions(spark, sf):
    out = scratch_path(spark, "sessions")
    live = stream_telemetry.stream_sessions(in_time_order(spark, sf), HOUR, ["instance"])
    runner.finish(runner.start_append(live, out, scratch_path(spark, "checkpoint")))
    return times_without_zone(spark.read.parquet(out)).select("instance", "first_seen", "last_seen", "n")
