import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
# Names that operators use inside or return; a table may have columns called the same.
CLASHING = ["score", "kept", "held_out", "predicted", "node", "label", "key", "size", "set", "id", "_id", "chunk", "trained", "value", "features",
            "position", "word", "sequence_id", "offset", "start", "registers", "n_words", "item_id", "high", "low"]
_RNG = random.Random(8)
PROSE = [" ".join(_RNG.choice(["The", "and", "of", "that", "in"]) if k % 3 == 0 else "".join(_RNG.choice("bdfghklmnprstvw") + _RNG.choice("aeiou") for _ in range(3))
                  for k in range(70)) + "." for _ in range(12)]
JUNK = ["the&&& of### in$$$ one*** " * 20 + "x" * i for i in range(6)]


def frame(spark, rows, clashing=True):
    """A documents table of (doc_id, text[, lang]) rows, with clashing columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, T.StructType([T.StructField(n, t) for n, t in FIELDS]))
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and blank texts, repeated rows, a very long text and a very long word."""
    rows = [(i, t) for i, t in enumerate(PROSE)] + [(20 + i, t) for i, t in enumerate(JUNK)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "one two"), (45, "ONE two"), (None, PROSE[0]), (None, None), (None, "lonely text here"),
             (46, PROSE[1]), (46, PROSE[1]), (47, PROSE[2], None), (48, "12 34 !! ..."), (49, "w" * 50_000), (50, "\0 zero\0byte " * 4),
             (51, " ".join(f"long{i % 9973}" for i in range(60_000)), "en"), (52, 'a token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" b')]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(12)] + [(20 + i, 0, 0) for i in range(6)] + [(None, 1, 0), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("score", F.lit(9))
