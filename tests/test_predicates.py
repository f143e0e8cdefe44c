import math

import pytest
from pyspark.sql import functions as F

from orderlens.functions.expressions import nan_to_null
from orderlens.operators import keywords, predicates, profiling

NAN = float("nan")


@pytest.fixture(scope="module")
def nulls(spark):
    rows = [(1, "Asia", 10.0), (2, None, 20.0), (3, "Europe", None), (4, "AFRICA", NAN), (5, "Asia", 50.0)]
    return nan_to_null(spark.createDataFrame(rows, "id int, market string, sales double")).persist()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def where(df, column, operator, value, **options):
    return ids(df.where(predicates.condition_predicate(df, column, operator, value, **options)))


def test_nan_becomes_null(nulls):
    assert ids(nulls.where("sales is null")) == [3, 4]


def test_comparisons_and_nulls(nulls):
    assert where(nulls, "market", "==", "Asia") == [1, 5]
    assert where(nulls, "market", "!=", "Asia") == [2, 3, 4]
    assert where(nulls, "sales", "!=", 10) == [2, 3, 4, 5]
    assert where(nulls, "sales", ">", "10") == [2, 5]
    assert where(nulls, "sales", ">=", 10) == [1, 2, 5]
    assert where(nulls, "sales", "<", 50) == [1, 2]
    assert where(nulls, "sales", "<=", 50.0) == [1, 2, 5]


def test_contains(nulls):
    assert where(nulls, "market", "contains", "A") == [1, 4, 5]
    assert where(nulls, "market", "contains", "^a.*a$", regex=True) == [1, 4, 5]
    assert where(nulls, "market", "contains", "^a.*a$") == []
    assert where(nulls, "sales", "contains", "0.0") == [1, 2, 5]
    assert where(nulls, "market", "contains", "nan") == []


def test_a_number_never_equals_a_text(nulls):
    assert where(nulls, "sales", "==", "ten") == []
    assert where(nulls, "sales", "!=", "ten") == [1, 2, 3, 4, 5]
    assert where(nulls, "market", "==", 5) == []


def test_bad_conditions_raise_or_are_skipped(nulls):
    for bad in (("x", "==", 1), ("sales", "~", 1), ("market", ">", 3), ("sales", ">", "many")):
        entry = [dict(zip(("column", "operator", "value"), bad))]
        with pytest.raises((ValueError, TypeError)):
            predicates.apply_conditions(nulls, entry)
        with pytest.warns(UserWarning):
            assert len(ids(predicates.apply_conditions(nulls, entry, lenient=True))) == 5


def test_filters(nulls):
    assert ids(predicates.apply_filters(nulls, {"sales": (10.0, 20.0)})) == [1, 2]
    assert ids(predicates.apply_filters(nulls, {"market": []})) == [1, 2, 3, 4, 5]
    assert ids(predicates.apply_filters(nulls, {"market": ["Asia"], "sales": (0, 20), "x": ["y"]})) == [1]


def test_filter_ratio_of_an_empty_table(nulls):
    row = predicates.filter_ratio(nulls.where("false"), F.col("sales") > 1).first()
    assert (row["total"], row["kept"], row["ratio"]) == (0, 0, 0.0)


def test_pick_list(nulls):
    assert predicates.pick_list(nulls, "market") == ["AFRICA", "Asia", "Europe"]
    assert predicates.pick_list(nulls, "market", limit=2) is None


def test_keyword_needs_whole_words(spark):
    df = spark.createDataFrame(
        [(1, "US"), (2, "US West"), (3, None), (4, "Asia")], "id int, market string"
    )
    assert ids(keywords.ask(df, "sales per customer in the Asia market")) == [4]
    assert ids(keywords.ask(df, "market us west")) == [2]
    assert ids(keywords.ask(df, "US market")) == [1]
    assert ids(keywords.ask(df, "everything")) == [1, 2, 3, 4]
    assert ids(keywords.ask(df, "market of a customer")) == [1, 2, 3, 4]


def test_shipping_passes_over_numeric_columns(spark):
    df = spark.createDataFrame(
        [(1, 3.0, "First Class"), (2, 4.0, "Same Day")], "id int, `Days for shipping (real)` double, `Shipping Mode` string"
    )
    assert ids(keywords.ask(df, "records with firstclass shipping")) == [1]
    assert ids(keywords.ask(df, "records with same day shipping")) == [2]


def test_summary_text(items):
    text = keywords.summary_text(items, "Europe market")
    assert "market = EUROPE" in text and "sum_sales" in text
    assert "market =" not in keywords.summary_text(items, "all of it")


def test_missing_and_profile(nulls):
    report = {r["column"]: (r["n_missing"], r["pct_missing"]) for r in profiling.missing_report(nulls).collect()}
    assert report == {"sales": (2, 40.0), "market": (1, 20.0)}
    assert profiling.missing_report(nulls.where("false")).count() == 0
    kinds = profiling.kind_counts(profiling.column_profile(nulls)).first()
    assert (kinds["n_numeric"], kinds["n_text"]) == (2, 1)


def test_ties_and_modes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert profiling.most_common(df, "x").first()["mode"] == "a"
    assert [tuple(r) for r in profiling.top_values(df, "x").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_histogram_ends(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "x double")
    rows = {r["bin"]: r["n"] for r in profiling.histogram(df, "x", 5).collect()}
    assert rows == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in profiling.histogram(constant, "x", 5).collect()] == [(0, 2)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, None), (3.0, 6.0, 5.0), (4.0, None, 6.0)], "a double, b double, c double")
    rows = {(r["a"], r["b"]): r["r"] for r in profiling.correlations(df).collect()}
    assert math.isclose(rows["a", "b"], 1.0)
    want = df.toPandas().corr()
    assert math.isclose(rows["a", "c"], want.loc["a", "c"])


def test_filter_reaches_the_scan_and_unused_tables_are_not_read(spark, folder):
    from orderlens.sources.order_items import order_items

    kept = predicates.apply_filters(order_items(spark, folder, ["sales", "quantity"]), {"sales": (10.0, 20.0)})
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_extendedprice,10.0)" in plan
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan
