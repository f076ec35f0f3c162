"""Domain rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinrisk.functions.features import Field
from clinrisk.schema import Rule


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def values_text(rule: Rule) -> str:
    return "[" + ", ".join(str(v) for v in rule.values) + "]"


def not_allowed(value: Column, rule: Rule) -> Column:
    """True for NULL and for every value outside the set; never NULL."""
    return ~F.coalesce(value.isin(*rule.values), F.lit(False))


def below(value: Column, rule: Rule) -> Column:
    return F.coalesce(value < F.lit(rule.min), F.lit(False))


def above(value: Column, rule: Rule) -> Column:
    return F.coalesce(value > F.lit(rule.max), F.lit(False))


def row_errors(field: Field, rules: list[Rule]) -> Column:
    """ARRAY<STRING> of one message per broken rule, NULL counting as a missing field."""
    checks = []
    for rule in rules:
        value, message = field(rule.column), None
        message = F.when(value.isNull(), F.lit(f"{rule.column}: field required"))
        if rule.values is not None:
            message = message.when(not_allowed(value, rule), F.lit(f"{rule.column}: must be one of {values_text(rule)}"))
        if rule.min is not None:
            text = f"{rule.column}: must be at least {_number(rule.min)}"
            message = message.when(below(value, rule), F.lit(text))
        if rule.max is not None:
            text = f"{rule.column}: must be at most {_number(rule.max)}"
            message = message.when(above(value, rule), F.lit(text))
        checks.append(message)
    return F.array_compact(F.array(*checks))

