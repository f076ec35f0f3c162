import math

import numpy as np
import pytest

from clinrisk.operators import explore as E


def test_fill_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (None, 4.0, None), (10, 4.0, None)], "a int, b double, c double")
    assert E.fit_fill(df, ["a", "b"]) == {"a": 2.0, "b": 4.0} and E.fit_fill(df, ["b"], "mean") == {"b": 3.0}
    rows = E.impute(df, E.fit_fill(df, ["a", "b"])).select("a", "b").collect()
    assert [tuple(r) for r in rows] == [(1.0, 1.0), (2.0, 4.0), (2.0, 4.0), (10.0, 4.0)]
    with pytest.raises(ValueError, match="No values"):
        E.fit_fill(df, ["c"])
    with pytest.raises(ValueError, match="strategy"):
        E.fit_fill(df, ["a"], "mode")


def test_ordinal_codes_follow_the_list(spark):
    df = spark.createDataFrame([("low",), ("high",), (None,), ("other",)], "s string")
    rows = E.ordinal_encode(df, {"s": ["low", "middle", "high"]}).collect()
    assert [r.s_code for r in rows] == [0, 2, None, None]
    assert E.fit_ordinal(df, ["s"]) == {"s": ["high", "low", "other", None]}


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0, None], [3.0, 3.0], [None], []])
def test_histogram_counts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = E.histogram(df, "x", 4).orderBy("bin").collect()
    known = [v for v in values if v is not None]
    if not known:
        assert rows == []
        return
    counts, edges = np.histogram(known, 4) if len(set(known)) > 1 else ([len(known)], [3.0, 4.0])
    assert [r.n for r in rows] == list(counts) and np.allclose([r.lower for r in rows], edges[:-1])


def test_label_tests_of_odd_columns(spark):
    rows = [(1.0, 5.0, None, 0), (2.0, 5.0, None, 0), (4.0, 5.0, 1.0, 1), (7.0, 5.0, 2.0, 1), (None, 5.0, 2.0, 1), (3.0, 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, constant double, one double, y int")
    got = {r["column"]: r for r in E.label_tests(df, ["a", "constant", "one"], "y").collect()}
    assert got["a"].r == pytest.approx(np.corrcoef([1, 2, 4, 7], [0, 0, 1, 1])[0, 1])
    assert got["a"].t == pytest.approx((5.5 - 1.5) / math.sqrt(0.5 / 2 + 4.5 / 2))
    assert got["constant"].r is None and got["constant"].t is None and got["one"].r is None and got["one"].t is None


def test_chi_square_with_empty_cells(spark):
    df = spark.createDataFrame([("a", 0)] * 8 + [("b", 1)] * 6 + [("b", 0)] * 4 + [("c", 1)] * 2 + [(None, 1), ("a", None)], "g string, y int")
    row = E.chi_square(df, "g", "y").first()
    table = np.array([[8, 0], [4, 6], [0, 2]], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / 20
    assert row.n == 20 and row.freedom == 2 and row.statistic == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert row.cramers_v == pytest.approx(math.sqrt(row.statistic / 20))
    assert tuple(E.chi_square(df.where("false"), "g", "y").first()) == (0, 0.0, 0, None)
    assert E.chi_square(df.where("g = 'a'"), "g", "y").first().cramers_v is None
