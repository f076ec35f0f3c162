"""Building blocks of the check SQL: the derived tables and their features, written for DuckDB."""

from __future__ import annotations

from clinrisk.sources.derived import (
    PATIENT_FAULTS, PATIENT_FIELDS, PREDICTION_FIELDS, REQUEST_SIZE, REQUEST_STRIDE, VERSION_FIELDS,
)
from clinrisk.schema import PATIENT_COLUMNS


def duck(sql: str) -> str:
    return sql.replace(" DIV ", " // ").replace("CAST(NULL AS INT)", "NULL")


def _fields(fields: dict[str, str], k: str | None = None) -> str:
    return ", ".join(f"{duck(e.format(k=k) if k else e)} AS {c}" for c, e in fields.items())


RISK_SCORE = (
    "(CASE WHEN age > 55 THEN 1 ELSE 0 END + CASE WHEN sex = 1 THEN 1 ELSE 0 END + CASE WHEN cp = 0 THEN 2 ELSE 0 END"
    " + CASE WHEN trestbps >= 140 THEN 1 ELSE 0 END + CASE WHEN chol >= 240 THEN 1 ELSE 0 END"
    " + CASE WHEN fbs = 1 THEN 1 ELSE 0 END + CASE WHEN exang = 1 THEN 2 ELSE 0 END"
    " + CASE WHEN oldpeak > 2 THEN 2 ELSE 0 END + CASE WHEN ca > 0 THEN 2 ELSE 0 END)"
)
AGE_GROUP = ("CASE WHEN age > 0 AND age <= 40 THEN 'young' WHEN age > 40 AND age <= 55 THEN 'middle'"
             " WHEN age > 55 AND age <= 70 THEN 'senior' WHEN age > 70 AND age <= 120 THEN 'elderly' END")
BP_CATEGORY = ("CASE WHEN trestbps < 120 THEN 'normal' WHEN trestbps < 130 THEN 'elevated' WHEN trestbps < 140 THEN"
               " 'high_stage1' WHEN trestbps >= 140 THEN 'high_stage2' ELSE 'unknown' END")
CHOL_RISK = ("CASE WHEN chol < 200 THEN 'desirable' WHEN chol < 240 THEN 'borderline' WHEN chol >= 240 THEN 'high'"
             " ELSE 'unknown' END")
RISK_LEVEL = "CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.3 THEN 'medium' ELSE 'low' END"

PATIENTS = (
    f"patients AS (SELECT p.*, CAST(CASE WHEN {RISK_SCORE} + (patient_id * 7907 + patient_id // 3) % 9 >= 10"
    f" THEN 1 ELSE 0 END AS INT) AS target FROM (SELECT o_orderkey AS patient_id, {_fields(PATIENT_FIELDS, 'o_orderkey')}"
    f" FROM orders) p)"
)


def faulty(c: str, k: str, v: str) -> str:
    return duck(PATIENT_FAULTS[c].format(k=k, v=v)) if c in PATIENT_FAULTS else v


RAW = (PATIENTS + ", raw AS (SELECT patient_id, "
       + ", ".join(f"{faulty(c, 'patient_id', c)} AS {c}" for c in PATIENT_COLUMNS) + " FROM patients)")
ENGINEERED = PATIENTS + (
    f", eng AS (SELECT *, {AGE_GROUP} AS age_group, {BP_CATEGORY} AS bp_category, {CHOL_RISK} AS cholesterol_risk,"
    f" 220 - age - thalach AS heart_rate_reserve, CAST({RISK_SCORE} AS INT) AS cardiac_risk_score, age * thalach AS age_x_thalach,"
    f" oldpeak * slope AS oldpeak_x_slope, cp * exang AS cp_x_exang FROM patients)"
)
PREDICTIONS = f"predictions AS (SELECT {_fields(PREDICTION_FIELDS)} FROM events)"
VERSIONS = (f"versions AS (SELECT {_fields(VERSION_FIELDS)}, CAST(1 + o_orderkey // 10000 AS INT) AS major,"
            f" CAST(o_orderkey // 100 % 100 AS INT) AS minor, CAST(o_orderkey % 100 AS INT) AS patch FROM orders)")

# Split: class quotas by largest remainder, then ranks in md5 order.
SPLIT = ENGINEERED + """,
cnt AS (SELECT target, count(*) AS nc FROM eng GROUP BY target),
tot AS (SELECT CAST(sum(nc) AS BIGINT) AS n, CAST(ceil(sum(nc) * (CAST(0.15 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT) AS held FROM cnt),
size3 AS (SELECT n, n - held AS n_train, held - CAST(ceil(held * CAST(0.5 AS DOUBLE)) AS BIGINT) AS n_val FROM tot),
q1 AS (SELECT target, nc, n_train, n_val, CAST(nc AS DOUBLE) / n * n_train AS x FROM cnt, size3),
q2 AS (SELECT target, nc, n_val, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, target)
       <= n_train - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS tr FROM q1),
q3 AS (SELECT target, tr, n_val, CAST(nc - tr AS DOUBLE) / sum(nc - tr) OVER () * n_val AS x FROM q2),
q4 AS (SELECT target, tr, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, target)
       <= n_val - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS va FROM q3),
splits AS (SELECT r.* EXCLUDE (rk), CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + va THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42-' || patient_id), patient_id) AS rk FROM eng) r
  JOIN q4 USING (target))"""

SCALED = ["age", "trestbps", "chol", "thalach", "oldpeak", "heart_rate_reserve", "cardiac_risk_score", "age_x_thalach",
          "oldpeak_x_slope", "cp_x_exang"]
PLAIN = ["sex", "fbs", "exang"]
LEVELS = {"cp": 4, "restecg": 3, "slope": 3, "ca": 5, "thal": 4}
ONEHOT = [(c, i) for c, n in LEVELS.items() for i in range(1, n)]
FEATURES = [*[f"f_{c}" for c in SCALED], *[f"f_{c}" for c in PLAIN], *[f"f_{c}_{i}" for c, i in ONEHOT]]

STATS = SPLIT + ", stats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED) + " FROM splits WHERE split = 'train')"
FEATURE_EXPRS = ", ".join(
    [f"({c} - m_{c}) / s_{c} AS f_{c}" for c in SCALED] + [f"CAST({c} AS DOUBLE) AS f_{c}" for c in PLAIN]
    + [f"coalesce(CAST({c} = {i} AS DOUBLE), 0.0) AS f_{c}_{i}" for c, i in ONEHOT])
FEATURE_TABLE = STATS + f", features AS (SELECT patient_id, target, split, {FEATURE_EXPRS} FROM splits, stats)"

# A model that stays the same on every input, so that scores can be compared across engines.
INTERCEPT = -0.3
COEFFICIENTS = {f: ((i * 37) % 19 - 9) / 10 for i, f in enumerate(FEATURES)}
MARGIN = f"({INTERCEPT}e0 + " + " + ".join(f"({b}e0) * {f}" for f, b in COEFFICIENTS.items()) + ")"
PROBABILITY = f"1.0 / (1.0 + exp(-{MARGIN}))"


def scored_from(source: str, columns: str) -> str:
    """SELECT of ``columns`` and ``probability`` for a relation with the raw patient fields."""
    derived = (f"SELECT *, 220 - age - thalach AS heart_rate_reserve, {RISK_SCORE} AS cardiac_risk_score,"
               f" age * thalach AS age_x_thalach, oldpeak * slope AS oldpeak_x_slope, cp * exang AS cp_x_exang FROM {source}")
    return (f"SELECT {columns}, {PROBABILITY} AS probability FROM (SELECT d.*, {FEATURE_EXPRS} FROM ({derived}) d, stats)")


_KEY = f"(o_orderkey * {REQUEST_STRIDE} + i)"
REQUEST_ROWS = (
    "request_rows AS (SELECT o_orderkey AS request_id, i, n, "
    + ", ".join(f"{faulty(c, _KEY, duck(e.format(k=_KEY)))} AS {c}" for c, e in PATIENT_FIELDS.items())
    + f" FROM (SELECT o_orderkey, n, unnest(range(0, n)) AS i FROM (SELECT o_orderkey, {REQUEST_SIZE} AS n FROM orders)))"
)
REQUEST_SIZES = f"request_sizes AS (SELECT o_orderkey AS request_id, CAST({REQUEST_SIZE} AS INT) AS n FROM orders)"
