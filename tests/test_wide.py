import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import categories, profiling, wide
from orderlens.plans import preparation


def test_300_columns_with_gaps_equal_pandas(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 300)) + 1e4 * (np.arange(300) % 3)
    base[:, 1] = base[:, 0] * 2 + 1
    base[:, 2] = 7.0
    base[rng.random(base.shape) < 0.2] = np.nan
    base[:, 5] = np.nan
    frame = pd.DataFrame(base, columns=[f"c.{i}" for i in range(300)])
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    scans = []
    monkeypatch.setattr(wide, "pair_sums", lambda *a, keep=wide.pair_sums: scans.append(1) or keep(*a))
    got = profiling.correlations(df.repartition(3)).toPandas().set_index(["a", "b"])["r"]
    assert len(got) == 300 * 299 // 2 and scans == [1]
    want = frame.corr()
    for (a, b), r in got.items():
        expected = want.loc[a, b]
        assert (math.isnan(r) and math.isnan(expected)) or r == pytest.approx(expected, abs=1e-8), (a, b)


def test_infinite_values_take_the_other_way(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0)], "a double, b double")
    assert wide.block_correlations(df, ["a", "b"]) is None
    empty = wide.block_correlations(df.where("false"), ["a", "b"])
    assert empty.collect() == []


def table(spark, n=5000):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 900).cast("string"))).alias("code.x"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("k"), (F.col("id") % 4).cast("string"))).alias("kind"),
    )


@pytest.mark.parametrize("limit", [100_000, 10])
def test_levels_by_broadcast_and_by_shuffle(spark, tmp_path, limit):
    df = table(spark)
    names = ["code.x", "kind"]
    categories.save_dictionary(categories.learn_dictionary(df, names, 6), str(tmp_path / "d"))
    dictionary = categories.load_dictionary(spark, str(tmp_path / "d"))
    scored = df.union(spark.createDataFrame([(-1, "never seen", None)] * 50, "id long, code string, kind string"))
    got = categories.with_levels(scored, dictionary, names, broadcast_values=limit).toPandas()
    assert len(got) == 5050 and list(got.columns) == ["id", *names, "code.x_index", "kind_index"]
    train = df.toPandas()
    for name in names:
        counts = train[name].fillna(categories.NO_VALUE).value_counts()
        levels = {v: i for i, v in enumerate(sorted(counts[counts >= 6].index))}
        want = got[name].fillna(categories.NO_VALUE).map(lambda v: levels.get(v, len(levels)))
        assert (got[f"{name}_index"] == want).all()


def test_levels_of_empty_tables(spark):
    df = table(spark, 50)
    dictionary = categories.learn_dictionary(df, ["kind"])
    assert categories.with_levels(df.where("false"), dictionary, ["kind"]).collect() == []
    unknown = categories.with_levels(df, categories.learn_dictionary(df.where("false"), ["kind"]), ["kind"])
    assert {r["kind_index"] for r in unknown.collect()} == {0}


def test_100_000_categories_train_and_score(spark):
    rows = spark.range(120_000).select(
        F.when(F.col("id") < 20_000, F.concat(F.lit("f"), (F.col("id") % 4).cast("string")))
        .otherwise(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("code"),
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("market"),
        (F.col("id") % 7).cast("double").alias("quantity"),
        (F.col("id") % 11).cast("double").alias("sales"),
    )
    fitted = preparation.fit_preparation(rows, ["quantity"], ["code", "market"], trailing=False, max_categories=4)
    more = spark.createDataFrame([("f1", "m0", 1.0, 1.0), ("new", "m9", 1.0, 1.0), ("r50000", "m1", 1.0, 1.0)], rows.schema)
    found = {r["code"]: (r["code_onehot"].toArray().tolist(), r["market_onehot"].toArray().tolist()) for r in fitted.transform(more).collect()}
    assert found["f1"] == ([0, 1, 0, 0, 0], [1, 0, 0])
    assert found["new"] == ([0, 0, 0, 0, 1], [0, 0, 0])
    assert found["r50000"] == ([0, 0, 0, 0, 1], [0, 1, 0])


def test_wide_columns_are_refused_on_demand(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("code"), F.col("id").cast("double").alias("quantity"), F.lit(1.0).alias("sales"))
    with pytest.raises(ValueError, match="too many distinct values"):
        preparation.fit_preparation(rows, ["quantity"], ["code"], trailing=False, max_categories=4, refuse_wide=True)
