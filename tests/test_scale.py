"""What must not be done again for every pass over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from orderlens.catalog import forecasting
from orderlens.functions import date_formats
from orderlens.operators import quantiles
from orderlens.plans import folds


def items_of(rows):
    columns = "days_real double, days_sched double, benefit double, sales_per_customer double, quantity double, sales double"
    values = np.random.default_rng(5).normal(size=(300, 6)).tolist()
    return lambda spark, folder, wanted: spark.createDataFrame(values[:rows], columns).select(*wanted)


def test_feature_selection_keeps_the_joined_rows(spark, monkeypatch):
    monkeypatch.setattr(forecasting, "order_items", items_of(300))
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    found = forecasting.select_best_features(spark, "").collect()
    assert len(found) == 3 and {r["n"] for r in found} == {300}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) - before


def test_products_by_fold_make_each_vector_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    values = np.random.default_rng(6).normal(size=(200, 2))
    rows = spark.createDataFrame([(float(a), float(b), i % 4) for i, (a, b) in enumerate(values)], "a double, sales double, fold int")
    rows = VectorAssembler(inputCols=["c"], outputCol="features").transform(rows.withColumn("c", counted("a"))).persist()
    rows.count()
    first = made.value
    grams, means = folds.fold_products(rows)
    assert np.allclose(means, values.mean(0))
    assert np.allclose(sum(grams.values())[:2, :2], (values - means).T @ (values - means))
    assert made.value == first
    plan = rows.select(*folds._columns("sales", "features"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("UDF(") == 1


def test_linear_members_keep_the_prepared_rows(spark, folder, monkeypatch):
    kept = []
    keep = forecasting.files.keep_for_reuse
    monkeypatch.setattr(forecasting.files, "keep_for_reuse", lambda df: kept.append(df.columns) or keep(df))
    assert forecasting.linear_members_cross_validation(spark, folder).count() == 15
    assert ["features", "sales", "fold"] in kept


def test_a_date_text_is_parsed_once_a_format(spark, monkeypatch):
    texts = spark.createDataFrame([("2024-01-05",), ("13/02/2024",), ("Mar 3, 2024",), ("20240405",), ("no date",), (None,)], "sold string")
    plans, agg = [], type(texts).agg
    monkeypatch.setattr(type(texts), "agg", lambda df, *made: plans.append(agg(df, *made)) or plans[-1])
    how = date_formats.infer_date_formats(texts, ["sold"])["sold"]
    assert (how.texts, how.unread, how.conflicting) == (5, 1, 0)
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("gettimestamp(") <= len(date_formats.PLAIN) + 2 * len(date_formats.TWOFOLD)
    assert date_formats.with_parsed_dates(texts, {"sold": how}).where("sold is not null").count() == 4


def test_marks_are_not_counted_by_one_aggregate_each(spark, monkeypatch):
    values = np.random.default_rng(7).normal(size=(400, 8))
    rows = spark.createDataFrame(values.tolist(), ", ".join(f"c{i} double" for i in range(8)))
    asked, select = [], type(rows).selectExpr
    monkeypatch.setattr(type(rows), "selectExpr", lambda df, *made: asked.extend(made) or select(df, *made))
    found = quantiles.exact_quantiles(rows, rows.columns, [0.25, 0.5, 0.75], small=10)
    for i, name in enumerate(f"c{i}" for i in range(8)):
        assert np.allclose(found[name], np.quantile(values[:, i], [0.25, 0.5, 0.75]))
    assert not [e for e in asked if isinstance(e, str) and "count_if" in e]
