"""Every registered query against its SQL on DuckDB, over whole tables at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clinrisk.catalog.queries import ORACLES, QUERIES
from tests.conftest import SF
from tools.check import TABLES, canonical

# Fits of all 27 features; their solver is held against SQL on two features (lr_fit_two and others).
ROWS_ONLY = {"lr_fit", "lr_fit_l1", "rfe", "importance_select", "importances", "grid_search", "train_plan", "random_search", "forest_fit", "boosted_plan", "short_plan"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    theirs = canonical([d[0] for d in result.description], result.fetchall())
    assert mine == theirs


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["roc_auc"] > 0.6


def test_fitted_coefficients_do_not_depend_on_the_run(spark):
    a, b = (entry.queries()["lr_fit"](spark, SF).orderBy("position").collect() for _ in range(2))
    assert a == b and len(a) == 28


def test_elimination_and_importance_queries(spark):
    assert entry.queries()["rfe"](spark, SF).where(F.col("rank") == 1).count() == 10
    rows = entry.queries()["importances"](spark, SF).collect()
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert 0 < entry.queries()["importance_select"](spark, SF).count() <= 27
