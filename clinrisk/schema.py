"""Column lists, types, rule sets and code dictionaries of the patient data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column names, in table order.
PATIENT_COLUMNS = [
    "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
    "thalach", "exang", "oldpeak", "slope", "ca", "thal", "target",
]
LABEL = "target"
REQUEST_COLUMNS = [c for c in PATIENT_COLUMNS if c != LABEL]

# Feature kinds.
CONTINUOUS = ["age", "trestbps", "chol", "thalach", "oldpeak"]
BINARY = ["sex", "fbs", "exang"]
CATEGORICAL = ["cp", "restecg", "slope", "ca", "thal"]

# Interaction pairs and numeric engineered columns of the model space.
INTERACTION_PAIRS = [("age", "thalach"), ("oldpeak", "slope"), ("cp", "exang")]
ENGINEERED_NUMERIC = ["heart_rate_reserve", "cardiac_risk_score"]


def column_type(name: str) -> T.DataType:
    return T.DoubleType() if name == "oldpeak" else T.IntegerType()


PATIENT_SCHEMA = T.StructType([T.StructField(c, column_type(c)) for c in PATIENT_COLUMNS])
REQUEST_SCHEMA = T.StructType([T.StructField(c, column_type(c)) for c in REQUEST_COLUMNS])
BATCH_REQUEST_SCHEMA = T.StructType([T.StructField("patients", T.ArrayType(REQUEST_SCHEMA))])


@dataclass(frozen=True)
class Rule:
    """Domain of one column: an inclusive range, a value set, or both."""

    column: str
    min: float | None = None
    max: float | None = None
    values: tuple[int, ...] | None = None


# Table rules (inclusive bounds or allowed codes).
TABLE_RULES = [
    Rule("age", min=0, max=120),
    Rule("sex", values=(0, 1)),
    Rule("cp", values=(0, 1, 2, 3)),
    Rule("trestbps", min=0, max=300),
    Rule("chol", min=0, max=600),
    Rule("fbs", values=(0, 1)),
    Rule("restecg", values=(0, 1, 2)),
    Rule("thalach", min=0, max=250),
    Rule("exang", values=(0, 1)),
    Rule("oldpeak", min=0, max=10),
    Rule("slope", values=(0, 1, 2)),
    Rule("ca", values=(0, 1, 2, 3, 4)),
    Rule("thal", values=(0, 1, 2, 3)),
    Rule("target", values=(0, 1)),
]

# Request rules; narrower ranges than the table rules, same codes.
REQUEST_RULES = [
    Rule("age", min=1, max=120),
    Rule("sex", values=(0, 1)),
    Rule("cp", values=(0, 1, 2, 3)),
    Rule("trestbps", min=80, max=220),
    Rule("chol", min=100, max=600),
    Rule("fbs", values=(0, 1)),
    Rule("restecg", values=(0, 1, 2)),
    Rule("thalach", min=60, max=220),
    Rule("exang", values=(0, 1)),
    Rule("oldpeak", min=0, max=10),
    Rule("slope", values=(0, 1, 2)),
    Rule("ca", values=(0, 1, 2, 3, 4)),
    Rule("thal", values=(0, 1, 2, 3)),
]

# Domain of a scored row (-1 marks a row that could not be scored).
SCORED_RULES = [
    Rule("prediction", min=-1, max=1),
    Rule("probability", min=0, max=1),
    Rule("confidence", min=0, max=1),
]
MAX_REQUEST_PATIENTS = 100

# Code to label dictionaries of the stored data.
DECODE_LABELS = {
    "cp": {0: "typical_angina", 1: "atypical_angina", 2: "non_anginal", 3: "asymptomatic"},
    "restecg": {0: "normal", 1: "st_t_abnormality", 2: "lv_hypertrophy"},
    "slope": {0: "upsloping", 1: "flat", 2: "downsloping"},
    "thal": {0: "unknown", 1: "normal", 2: "fixed_defect", 3: "reversible_defect"},
    "target": {0: "healthy", 1: "heart_disease"},
}
# The other published labelling of `thal`; pass it to decode_labels to use it.
THAL_LABELS_ALTERNATIVE = {0: "normal", 1: "fixed_defect", 2: "reversible_defect", 3: "unknown"}

# Labels shown to people, in code order.
DISPLAY_LABELS = {
    "sex": ["Female", "Male"],
    "cp": ["Typical Angina", "Atypical Angina", "Non-anginal Pain", "Asymptomatic"],
    "fbs": ["No", "Yes"],
    "restecg": ["Normal", "ST-T Wave Abnormality", "Left Ventricular Hypertrophy"],
    "exang": ["No", "Yes"],
    "slope": ["Upsloping", "Flat", "Downsloping"],
    "thal": ["Unknown", "Normal", "Fixed Defect", "Reversible Defect"],
}
