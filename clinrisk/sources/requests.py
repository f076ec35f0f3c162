"""JSON request payloads: parsing and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinrisk.functions.rows import computed_once
from clinrisk.schema import REQUEST_COLUMNS, REQUEST_SCHEMA


def parse_requests(df: DataFrame, body: str = "body", schema: T.StructType = REQUEST_SCHEMA) -> DataFrame:
    """Append ``valid_json``, ``missing`` and ``invalid`` (ARRAY<STRING>, NULL for invalid JSON) and the request fields as columns.

    Text that is not a JSON object has no keys. Numbers are read as such however they are written: ``55.0`` is the integer
    55. A value that is no number, or no integer where one is wanted, is NULL and its field listed in ``invalid``; a JSON null
    is NULL and not listed.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = computed_once(df, {"_keys": F.json_object_keys(body), "_request": F.from_json(body, as_text, {"mode": "PERMISSIVE"})})
    numbers = computed_once(parsed, {"_numbers": F.struct(*[
        F.col("_request")[f.name].try_cast("double").alias(f.name) for f in schema])})
    values, invalid = {}, []
    for f in schema:
        number = F.col("_numbers")[f.name]
        fits = ~F.isnan(number) & (F.abs(number) < float(2**31))
        if isinstance(f.dataType, T.IntegerType):
            fits = fits & (number == F.floor(number))
        values[f.name] = F.when(fits, number.cast(f.dataType))
        invalid.append(F.when(F.col("_request")[f.name].isNotNull() & ~F.coalesce(fits, F.lit(False)), F.lit(f.name)))
    required = F.array(*[F.lit(c) for c in REQUEST_COLUMNS])
    return numbers.select(*df.columns, F.col("_keys").isNotNull().alias("valid_json"),
                          F.array_except(required, "_keys").alias("missing"),
                          F.when(F.col("_keys").isNotNull(), F.array_compact(F.array(*invalid))).alias("invalid"),
                          *[e.alias(c) for c, e in values.items()])
