import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens.columns import ITEM_ORDER, NUMERIC
from orderlens.operators import paging
from orderlens.operators.evaluation import resilience
from orderlens.operators.features import statistical_features, zscores
from orderlens.operators.ordered import _in_order, dense_index, percentile_rank, trailing_mean, trailing_window
from orderlens.operators.quantiles import approximate_quantiles, exact_quantiles


def test_dense_index_is_the_sort_position(items, frame):
    got = dense_index(items, ITEM_ORDER).orderBy("idx").toPandas()
    assert got["idx"].tolist() == list(range(len(frame)))
    assert got["order_id"].tolist() == frame["order_id"].tolist()


def test_dense_index_splits_a_hot_leading_value(spark):
    rows = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("day"), "id")
    indexed = dense_index(rows, ["day", "id"], partitions=8)
    want = rows.toPandas().sort_values(["day", "id"])["id"].tolist()
    assert indexed.orderBy("idx").toPandas()["id"].tolist() == want
    sizes = _in_order(rows, ["day", "id"], 8).groupBy("_part").count().toPandas()["count"]
    assert sizes.max() < 2 * sizes.mean()


def test_dense_index_of_an_empty_table(spark):
    assert dense_index(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("broadcast_values", [10**6, 3])
@pytest.mark.parametrize("hot_share", [0.001, 0.2, 1.1])
def test_percentile_rank_equals_pandas(spark, broadcast_values, hot_share):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(900) < 0.4, 5.0, np.round(rng.normal(size=900) * 20))
    rows = [(i, float(v) if i % 7 else None, float(i % 2)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, x double, y double").repartition(5)
    got = percentile_rank(df, ["x", "y"], broadcast_values=broadcast_values, hot_share=hot_share).toPandas()
    assert len(got) == 900
    for c in ("x", "y"):
        np.testing.assert_allclose(got[f"{c}_percentile"], got[c].rank(pct=True), rtol=1e-12)


def test_hot_rows_are_spread_by_the_shuffled_join(spark):
    """A third of the rows hold one value and a fifth none: no task may get such a group whole."""
    x = F.when(F.col("id") % 3 == 0, -0.0).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") * 1.0)
    df = spark.range(0, 60_000, 1, 8).select("id", x.alias("x"))
    ranked = percentile_rank(df, ["x"], broadcast_values=10, hot_share=0.01, partitions=8)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line and "_key" in line]
    assert len(shuffles) == 1 and "_salt" in shuffles[0].split("hashpartitioning")[1]
    got = ranked.toPandas()
    np.testing.assert_allclose(got["x_percentile"], got["x"].rank(pct=True), rtol=1e-12)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = ranked.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.max() < 1.4 * sizes.mean()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_percentile_rank_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "id int, x double")
    assert [r["x_percentile"] for r in percentile_rank(df, ["x"]).collect()] == [None, None]


def test_percentile_rank_does_not_depend_on_partitions(items):
    def run(df, partitions):
        return percentile_rank(df.select(*ITEM_ORDER, "benefit"), ["benefit"], partitions=partitions).toPandas()

    a, b = run(items, 3), run(items.repartition(11), 7)
    a, b = (t.sort_values(ITEM_ORDER)["benefit_percentile"].to_numpy() for t in (a, b))
    assert (a == b).all() and a.min() > 0 and a.max() <= 1


@pytest.mark.parametrize("block", [None, 50, 61, 10_000])
def test_trailing_mean_equals_a_plain_rolling_mean(items, frame, block):
    got = trailing_mean(items, NUMERIC, ITEM_ORDER, block=block).toPandas().sort_values(ITEM_ORDER)
    for c in NUMERIC:
        want = frame[c].rolling(50, min_periods=1).mean()
        np.testing.assert_allclose(got[f"{c}_ma"].to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("n", [1, 19, 20, 45])
def test_trailing_mean_of_small_tables(spark, n):
    df = spark.createDataFrame([(i, float(i) if i % 3 else None) for i in range(n)], "id int, x double")
    got = trailing_mean(df, ["x"], ["id"]).toPandas().sort_values("id")
    want = got["x"].rolling(trailing_window(n), min_periods=1).mean()
    np.testing.assert_allclose(got["x_ma"].to_numpy(), want.to_numpy())


def test_a_block_must_hold_a_window(items):
    with pytest.raises(ValueError):
        trailing_mean(items, ["sales"], ITEM_ORDER, block=10)


def test_no_window_runs_on_a_single_partition(items):
    made = statistical_features(items.select(*ITEM_ORDER, "benefit"), ["benefit"], ITEM_ORDER)
    plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
    for number, line in enumerate(plan):
        if "Window [" in line:
            depth = line.index("Window")
            below = []
            for later in plan[number + 1 :]:
                start = len(later) - len(later.lstrip(" :+-"))
                if start <= depth - 3:
                    break
                below.append(later)
            exchange = next(item for item in below if "Exchange" in item)
            assert "SinglePartition" not in exchange


def test_zscore_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x_zscore"] for r in zscores(df, ["x"]).collect()] == [0.0, 0.0]


def test_deep_and_shallow_pages_agree(items):
    shallow = paging.page(items, ITEM_ORDER, 120, 30).collect()
    deep = paging.page(items, ITEM_ORDER, 120, 30, shallow_rows=10).collect()
    assert shallow == deep and len(deep) == 30
    assert paging.page(items, ITEM_ORDER, 10**6, 30).count() == 0


def test_resilience_equals_numpy(spark):
    rng = np.random.default_rng(3)
    y = np.arange(300) * 0.5 + rng.normal(size=300)
    p = y + rng.normal(size=300) * 0.3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y double, p double")
    row = resilience(df, "y", "p", ["id"]).first()
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    mae = np.abs(y - p).mean()
    volatility = min(p.std() / (y.std() + 1e-8), 1)
    sp, sa = np.polyfit(range(300), p, 1)[0], np.polyfit(range(300), y, 1)[0]
    trend = 1 - abs(sp - sa) / (abs(sa) + 1e-8)
    score = 0.4 * r2 + 0.3 * (1 - mae / (y.mean() + 1e-8)) + 0.2 * volatility + 0.1 * max(0, trend)
    np.testing.assert_allclose(
        [row["r2"], row["mae"], row["volatility_ratio"], row["trend_similarity"], row["resilience_score"]],
        [r2, mae, volatility, trend, score],
        rtol=1e-9,
    )


# ---- quantiles


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=80),
    size=st.sampled_from([8, 200]),
)
def test_exact_quantiles_equal_numpy(spark, values, size):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probabilities, size=size, slack=0.05, small=3)["x"]
    filled = [v for v in values if v is not None]
    if filled:
        np.testing.assert_allclose(got, np.quantile(filled, probabilities), rtol=1e-12, atol=1e-9)
    else:
        assert got == [None] * 5


def test_exact_quantiles_with_hot_values(spark):
    ids = spark.range(0, 30_000, 1, 8)
    df = ids.select(F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.col("id") * 0.1).alias("x"), F.lit(2.0).alias("c"))
    values = df.toPandas()["x"]
    probabilities = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = exact_quantiles(df, ["x", "c"], probabilities, size=20, slack=0.02, small=20)
    np.testing.assert_allclose(got["x"], np.quantile(values, probabilities))
    assert got["c"] == [2.0] * 5


def test_approximate_quantiles(items, frame):
    got = approximate_quantiles(items, ["sales"], [0.5])["sales"][0]
    assert abs((frame["sales"] <= got).mean() - 0.5) < 2e-3


def test_percentile_rank_counts_rows_where_they_lie(spark):
    """Running counts over batches and partitions, several columns in one partition; no window moves the values again."""
    values = [float(i * 7919 % 3001) for i in range(25_000)]
    df = spark.createDataFrame([(i, v, -v if i % 3 else None, float(i % 4)) for i, v in enumerate(values)], "id long, a double, b double, c double")
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = percentile_rank(df, ["a", "b", "c"], broadcast_values=1000, partitions=2).orderBy("id").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    want = df.orderBy("id").toPandas()[["a", "b", "c"]].rank(pct=True)
    for name in "abc":
        np.testing.assert_allclose(got[f"{name}_percentile"], want[name], rtol=1e-12)
