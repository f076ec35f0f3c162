"""Clinical features as Column expressions.

Every function maps Columns to a Column, so the same code runs over table columns, over the fields of a struct inside an
array (``F.transform``) and over streams, all inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.schema import DECODE_LABELS, DISPLAY_LABELS, INTERACTION_PAIRS

Field = Callable[[str], Column]


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins: label i for edges[i] < value <= edges[i+1], NULL outside."""
    out = F.when(value <= edges[0], F.lit(None))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= upper, label)
    return out


def steps(value: Column, bounds: list[float], labels: list[str], missing: str | None = None) -> Column:
    """Left-closed bins: labels[i] below bounds[i], the last label at or above the last bound."""
    out = F.when(value.isNull(), F.lit(missing))
    for bound, label in zip(bounds, labels):
        out = out.when(value < bound, label)
    return out.otherwise(labels[-1])


# Clinical cut points, class names and score weights.
AGE_EDGES, AGE_LABELS = [0, 40, 55, 70, 120], ["young", "middle", "senior", "elderly"]
BP_BOUNDS, BP_LABELS = [120, 130, 140], ["normal", "elevated", "high_stage1", "high_stage2"]
CHOL_BOUNDS, CHOL_LABELS = [200, 240], ["desirable", "borderline", "high"]
MAX_HEART_RATE = 220
RISK_INPUTS = ["age", "sex", "cp", "trestbps", "chol", "fbs", "exang", "oldpeak", "ca"]


def age_group(age: Column) -> Column:
    return cut(age, AGE_EDGES, AGE_LABELS)


def bp_category(trestbps: Column) -> Column:
    return steps(trestbps, BP_BOUNDS, BP_LABELS, missing="unknown")


def cholesterol_risk(chol: Column) -> Column:
    return steps(chol, CHOL_BOUNDS, CHOL_LABELS, missing="unknown")


def heart_rate_reserve(age: Column, thalach: Column) -> Column:
    return F.lit(MAX_HEART_RATE) - age - thalach


def st_risk_score(oldpeak: Column, slope: Column) -> Column:
    return oldpeak * (slope + 1)


def cardiac_risk_score(field: Field) -> Column:
    """Sum of the weights of the conditions that hold; a NULL input makes its condition not hold."""
    # Weighted risk conditions.
    weighted = [
        (field("age") > 55, 1),
        (field("sex") == 1, 1),
        (field("cp") == 0, 2),
        (field("trestbps") >= 140, 1),
        (field("chol") >= 240, 1),
        (field("fbs") == 1, 1),
        (field("exang") == 1, 2),
        (field("oldpeak") > 2, 2),
        (field("ca") > 0, 2),
    ]
    total = F.lit(0)
    for holds, weight in weighted:
        total = total + F.when(holds, weight).otherwise(0)
    return total


def interaction_columns(field: Field, columns: Iterable[str], pairs=None) -> dict[str, Column]:
    """Products ``a_x_b`` of the pairs whose two columns are present."""
    present = set(columns)
    pairs = INTERACTION_PAIRS if pairs is None else pairs
    return {f"{a}_x_{b}": field(a) * field(b) for a, b in pairs if {a, b} <= present}


def engineered_columns(
    field: Field,
    columns: Iterable[str],
    age_groups: bool = True,
    bp: bool = True,
    cholesterol: bool = True,
    reserve: bool = True,
    risk_score: bool = True,
    interactions: bool = True,
) -> dict[str, Column]:
    """The derived columns that the given input columns allow, by name and in a fixed order."""
    present = set(columns)
    out: dict[str, Column] = {}
    if age_groups and "age" in present:
        out["age_group"] = age_group(field("age"))
    if bp and "trestbps" in present:
        out["bp_category"] = bp_category(field("trestbps"))
    if cholesterol and "chol" in present:
        out["cholesterol_risk"] = cholesterol_risk(field("chol"))
    if reserve and {"age", "thalach"} <= present:
        out["heart_rate_reserve"] = heart_rate_reserve(field("age"), field("thalach"))
    if risk_score and set(RISK_INPUTS) <= present:
        out["cardiac_risk_score"] = cardiac_risk_score(field)
    if interactions:
        out.update(interaction_columns(field, columns))
    return out


def engineer_features(df: DataFrame, **flags: bool) -> DataFrame:
    """Append all derived columns in one projection."""
    return df.withColumns(engineered_columns(F.col, df.columns, **flags))


def add_interactions(df: DataFrame, pairs=None) -> DataFrame:
    return df.withColumns(interaction_columns(F.col, df.columns, pairs))


def risk_factors(field: Field) -> Column:
    """ARRAY<STRUCT<factor, level, title, detail>>: one traffic-light entry per risk factor; ``inline`` gives rows."""

    def entry(factor: str, grades: list[tuple[Column | None, str, str, Column]]) -> Column:
        chosen = None
        for holds, level, title, detail in grades:
            item = F.struct(
                F.lit(factor).alias("factor"), F.lit(level).alias("level"),
                F.lit(title).alias("title"), detail.alias("detail"),
            )
            if holds is None:
                return item if chosen is None else chosen.otherwise(item)
            chosen = F.when(holds, item) if chosen is None else chosen.when(holds, item)
        return chosen

    def shown(prefix: str, name: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), F.coalesce(field(name).cast("string"), F.lit("unknown")), F.lit(suffix))

    bp, chol, oldpeak = field("trestbps"), field("chol"), field("oldpeak")
    # Factor titles, texts and cut points.
    return F.array(
        entry("age", [
            (field("age") > 55, "red", "Age > 55 years", F.lit("Higher risk with advancing age")),
            (None, "green", "Age ≤ 55 years", F.lit("Lower age-related risk")),
        ]),
        entry("blood_pressure", [
            (bp >= 140, "red", "High Blood Pressure", shown("BP: ", "trestbps", " mmHg (Stage 2 Hypertension)")),
            (bp >= 130, "amber", "Elevated Blood Pressure", shown("BP: ", "trestbps", " mmHg (Stage 1 Hypertension)")),
            (None, "green", "Normal Blood Pressure", shown("BP: ", "trestbps", " mmHg")),
        ]),
        entry("cholesterol", [
            (chol >= 240, "red", "High Cholesterol", shown("Cholesterol: ", "chol", " mg/dl")),
            (chol >= 200, "amber", "Borderline Cholesterol", shown("Cholesterol: ", "chol", " mg/dl")),
            (None, "green", "Healthy Cholesterol", shown("Cholesterol: ", "chol", " mg/dl")),
        ]),
        entry("exercise_angina", [
            (field("exang") == 1, "red", "Exercise-Induced Angina", F.lit("Chest pain during physical activity")),
            (None, "green", "No Exercise Angina", F.lit("No chest pain during activity")),
        ]),
        entry("st_depression", [
            (oldpeak > 2, "red", "Significant ST Depression", shown("Oldpeak: ", "oldpeak")),
            (oldpeak > 1, "amber", "Moderate ST Depression", shown("Oldpeak: ", "oldpeak")),
            (None, "green", "Minimal ST Depression", shown("Oldpeak: ", "oldpeak")),
        ]),
    )


def _lookup(value: Column, table: Mapping) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), value)


def decode_labels(df: DataFrame, labels: Mapping[str, Mapping[int, str]] | None = None) -> DataFrame:
    """Append ``<column>_label`` for every coded column present; codes without a label give NULL."""
    labels = DECODE_LABELS if labels is None else labels
    return df.withColumns({f"{c}_label": _lookup(F.col(c), t) for c, t in labels.items() if c in df.columns})


def encode_labels(df: DataFrame, labels: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Replace display labels by their codes; an unknown label gives NULL."""
    labels = DISPLAY_LABELS if labels is None else labels
    return df.withColumns({
        c: _lookup(F.col(c), {label: code for code, label in enumerate(names)})
        for c, names in labels.items() if c in df.columns
    })
