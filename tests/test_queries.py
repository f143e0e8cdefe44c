"""Every registered query against its SQL twin, over the whole tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_points
from orderlens.catalog import forecasting
from orderlens.plans import models

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, con, name):
    got = QUERIES[name](spark, folder).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None
    assert len(got) > 0


#: Fits without a twin, here with fewer trees; compare.py runs them at full size.
SMALLER = {"tree_models", "forest_cross_validation", "feature_importances"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, folder, name, monkeypatch):
    if name in SMALLER:
        monkeypatch.setattr(forecasting, "SIZES", models.Sizes(20, 20, 20, 20))
    rows = QUERIES[name](spark, folder).collect()
    assert rows
    for row in rows:
        assert all(value is not None for value in row)
    if name in ("tree_models", "forest_cross_validation"):
        assert min(row["r2"] for row in rows) > 0.9
    if name == "feature_importances":
        assert rows[0]["feature"].startswith("sales_per_customer")
    if name == "forecast_test_rows":  # the whole forecaster at full size
        inside = sum(row["prediction_lower"] <= row["sales"] <= row["prediction_upper"] for row in rows)
        assert inside > 0.8 * len(rows)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


def test_names_and_columns_agree():
    assert set(SQL) <= set(QUERIES)
