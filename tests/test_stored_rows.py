"""Prepared rows are stored once, with their trailing means made while they lie in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators.ordered import stored_trailing_mean, trailing_mean
from orderlens.plans import forecast


def table(spark, rows):
    rng = np.random.default_rng(8)
    values = [(i, float(x), None if x < -0.8 else float(3 * x), "a" if i % 3 else None) for i, x in enumerate(rng.normal(size=rows))]
    return spark.createDataFrame(values, "n long, a double, b double, c string").orderBy(F.rand(1))


@pytest.mark.parametrize(("rows", "partitions"), [(1300, 4), (1300, 40), (1300, 1), (120, 3), (19, 4), (1, 2), (0, 2)])
def test_stored_means_equal_those_by_blocks(spark, rows, partitions):
    df = table(spark, rows)
    got, window = stored_trailing_mean(df, ["a", "b"], ["n"], partitions=partitions)
    assert window == max(1, min(50, rows // 20))
    want = {r["n"]: r for r in trailing_mean(df, ["a", "b"], ["n"], window).collect()}
    found = got.collect()
    assert got.columns == [*df.columns, "a_ma", "b_ma"] and len(found) == rows
    for row in found:
        for name in got.columns:
            assert row[name] == want[row["n"]][name] or row[name] == pytest.approx(want[row["n"]][name], rel=1e-9, abs=1e-12)


def test_nan_is_a_value_as_in_an_average(spark):
    df = spark.range(1200).withColumn("x", F.when(F.col("id") == 700, float("nan")).otherwise(F.col("id").cast("double")))
    got, window = stored_trailing_mean(df, ["x"], ["id"], partitions=7)
    assert window == 50
    assert sorted(r["id"] for r in got.where(F.isnan("x_ma")).collect()) == list(range(700, 750))


@pytest.mark.parametrize("trailing", [True, False])
def test_prepared_rows_fill_no_cache(spark, items, trailing):
    some = items.limit(1500)
    some.count()  # fills the cache of the items
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    prepared = forecast.prepare(some, trailing=trailing)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    assert prepared.rows.count() == 1500 and {"split", "fold"} <= set(prepared.rows.columns)
