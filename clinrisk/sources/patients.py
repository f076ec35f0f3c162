"""Patient table source: CSV scan, schema check, profile."""

from __future__ import annotations

import csv
import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinrisk.schema import PATIENT_COLUMNS, PATIENT_SCHEMA

log = logging.getLogger(__name__)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL: Spark orders NaN above every number, so a NaN would pass `x > bound` tests."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


CORRUPT = "_corrupt_record"


def read_patients(spark: SparkSession, path: str, schema: T.StructType = PATIENT_SCHEMA, corrupt: bool = False) -> DataFrame:
    """Scan headed CSV without a type-inference pass.

    Only the header is read up front: declared columns get their declared type, other columns are kept as text. Files of a
    folder may order their columns differently: each set of files with one header is read by that header. A malformed field
    becomes NULL; with ``corrupt`` the column ``_corrupt_record`` keeps the text of lines that are too short, too long or hold
    such a field, and is NULL for others. A missing path raises ``FileNotFoundError``.
    """
    declared = {f.name: f for f in schema}
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Data file not found: {path}") from error
        raise
    parts = []
    for names, files in _headers(spark, path, header).items():
        fields = [declared.get(c, T.StructField(c, T.StringType())) for c in names]
        reader = spark.read.option("header", True).option("enforceSchema", False)
        if corrupt:
            # Without pruning, or lines would be judged by the columns that a query asks for.
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
            fields = [*fields, T.StructField(CORRUPT, T.StringType())]
        parts.append(reader.schema(T.StructType(fields)).csv(files))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return nan_to_null(out)


def _headers(spark: SparkSession, path: str, header: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header. The lines are scanned once, without parsing, for the first one of each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                        F.monotonically_increasing_id().alias("at"))
    first = (lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
             .groupBy("line").agg(F.collect_list("file").alias("files")).collect())
    if len(first) <= 1:
        return {tuple(header): [path]}
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first:
        names = next(csv.reader([r["line"]]))
        out.setdefault(tuple(names), []).extend(sorted(r["files"]))
    return out


def malformed(df: DataFrame) -> DataFrame:
    """One row of a table read with ``corrupt``: ``n_rows``, ``n_malformed``, and per column how many values were read."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(CORRUPT).alias("n_malformed"),
                  *[F.count(c).alias(f"n_{c}") for c in df.columns if c != CORRUPT])


def validate_schema(df: DataFrame, expected: list[str] | None = None) -> bool:
    """Raise ``ValueError`` on missing columns; warn of extra ones. Plan-time only, starts no job."""
    expected = PATIENT_COLUMNS if expected is None else expected
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    extra = [c for c in df.columns if c not in expected]
    if extra:
        log.warning("Extra columns: %s", extra)
    return True


def type_report(df: DataFrame, schema: T.StructType = PATIENT_SCHEMA) -> dict[str, tuple[str, str]]:
    """Columns whose type differs from the declared one: name -> (declared, found)."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    return {
        f.name: (f.dataType.simpleString(), found[f.name])
        for f in schema if f.name in found and found[f.name] != f.dataType.simpleString()
    }


def profile(df: DataFrame) -> DataFrame:
    """One row per column ``(position, column, dtype, n_rows, n_columns, n_missing)`` from a single aggregate."""
    types = [f.dataType.simpleString() for f in df.schema]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                 F.col("n_rows"), F.lit(len(types)).alias("n_columns"), F.col(f"m{i}").alias("n_missing"))
        for i, (c, t) in enumerate(zip(df.columns, types))
    ])
    return counts.select(F.inline(rows))


def estimated_megabytes(df: DataFrame) -> float:
    """Size in MB from the optimizer's statistics; no scan."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return float(str(size)) / 1024 / 1024
