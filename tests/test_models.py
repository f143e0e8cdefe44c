import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from orderlens.columns import CATEGORICAL, ITEM_KEY, ITEM_ORDER, NUMERIC, TARGET
from orderlens.operators import evaluation, scoring
from orderlens.operators.predicates import all_of
from orderlens.plans import bundle as bundles
from orderlens.plans import folds, forecast, models, preparation
from orderlens.sources.sinks import training_metadata
from orderlens.streaming import scorer

TINY = models.Sizes(trees=3, rounds=2, importance_trees=2, fold_trees=2)
LINEAR = ["elastic_net", "ridge", "bayesian_ridge"]


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 3, 0.2, 9]
    x[:, 3] += 2 * x[:, 0]
    y = x @ [3, -2, 5, 0.5] + rng.normal(size=300) * 4 + 60
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, sales double")
    prepared = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).persist()
    return prepared, x, y


def test_ridge_equals_the_direct_solution(toy):
    df, x, y = toy
    n, sd = models.label_stats(df)
    fit = models.ridge(n, sd).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    np.testing.assert_allclose(fit.coefficients.toArray(), want, rtol=1e-9)
    np.testing.assert_allclose(fit.intercept, y.mean() - x.mean(0) @ want, rtol=1e-9)


def test_elastic_net_meets_its_optimality_conditions(toy):
    df, x, y = toy
    fit = models.elastic_net(models.label_stats(df)[1]).fit(df)
    w = fit.coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    gradient = xc.T @ (yc - xc @ w) / len(y) - 0.05 * w
    for g, weight in zip(gradient, w):
        assert abs(g) <= 0.05 + 1e-6
        if weight:
            assert abs(g - 0.05 * np.sign(weight)) < 1e-5


def test_evidence_penalty_maximises_the_evidence(toy):
    df, x, y = toy
    gram = models.gram_matrix(df, TARGET)
    z = np.column_stack([x, y, np.ones(len(y))])
    np.testing.assert_allclose(gram, z.T @ z, rtol=1e-9)
    penalty = models.evidence_penalty(gram, tolerance=1e-9)

    xc, yc = x - x.mean(0), y - y.mean()

    def evidence(ratio):
        """Log evidence with the best noise precision for this ratio of the two precisions."""
        w = np.linalg.solve(xc.T @ xc + ratio * np.eye(4), xc.T @ yc)
        cost = ((yc - xc @ w) ** 2).sum() + ratio * w @ w
        noise = len(y) / cost
        determinant = np.linalg.slogdet(xc.T @ xc + ratio * np.eye(4))[1]
        return len(y) / 2 * np.log(noise) + 2 * np.log(ratio) - noise / 2 * cost - determinant / 2

    assert evidence(penalty) >= max(evidence(penalty * f) for f in (0.8, 0.9, 1.1, 1.25)) - 1e-9


def dependent_columns(rows, largest):
    """Features of which several add up to others, one with a single huge value, and a label, drawn with a fixed seed."""
    random = np.random.default_rng(11)
    group, x = random.integers(0, 6, rows), random.normal(size=rows)
    ratio = random.normal(size=rows)
    ratio[7] = largest
    features = np.column_stack([np.eye(6)[group], x, (x - 0.3) / 1.7, x * x, ratio])
    return features, 5 * x + 0.4 * group + random.normal(scale=0.6, size=rows)


def evidence_from_rows(x, y, rounds=300):
    """The same updates from the singular values of the rows, where rounding disturbs the dependent directions far less."""
    x, y = x - x.mean(0), y - y.mean()
    left, roots, _ = np.linalg.svd(x, full_matrices=False)
    left, roots = left[:, roots > 1e-9], roots[roots > 1e-9]
    fit, noise, weight = left.T @ y, 1 / y.var(), 1.0
    for _ in range(rounds):
        kept = roots**2 / (roots**2 + weight / noise)
        error = ((y - left @ (kept * fit)) ** 2).sum()
        effective, size = kept.sum(), ((kept * fit / roots) ** 2).sum()
        weight, noise = (effective + 2e-6) / (size + 2e-6), (len(y) - effective + 2e-6) / (error + 2e-6)
    return weight / noise


@pytest.mark.parametrize("largest", [3.0, 1e6, 1e8, 1e10])
@pytest.mark.parametrize("copies", [1, 60])
def test_evidence_penalty_of_dependent_columns_with_a_huge_value(largest, copies):
    """What rounding leaves of dependent columns once grew until the penalty was NaN, which no estimator takes."""
    x, y = dependent_columns(400, largest)
    rows = np.column_stack([x, y, np.ones(len(y))])
    rounding = np.random.default_rng(copies).uniform(-1e-14, 1e-14, (rows.shape[1],) * 2)
    gram = copies * (rows.T @ rows) * (1 + rounding + rounding.T)
    expected = evidence_from_rows(np.tile(x, (copies, 1)), np.tile(y, copies))
    assert models.evidence_penalty(gram, tolerance=1e-9) == pytest.approx(expected, rel=1e-4)
    assert np.isfinite(folds.evidence_weights(gram)).all()


@pytest.fixture(scope="module")
def dependent(spark):
    """60 copies of rows on which the fit ended failed: regParam given invalid value NaN."""
    x, y = dependent_columns(400, 1e8)
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], ", ".join(f"{c} double" for c in [*names, TARGET]))
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows.crossJoin(spark.range(60))).persist()


def test_linear_members_fit_dependent_columns_with_a_huge_value(dependent):
    fitted = PipelineModel(models.fit_models(dependent, models.MODEL_NAMES[3:])).transform(dependent)
    for name in models.MODEL_NAMES[3:]:
        assert fitted.select(evaluation.r_squared(F.col(TARGET), F.col(name)).alias("r2")).first()["r2"] > 0.95


def test_saved_members_of_dependent_columns_predict_the_same(spark, dependent, tmp_path):
    pipeline = PipelineModel(models.fit_models(dependent, ["bayesian_ridge"]))
    bundles.save_bundle(bundles.Bundle(pipeline), str(tmp_path / "b"))
    first = pipeline.transform(dependent).withColumnRenamed("bayesian_ridge", "before")
    both = bundles.load_bundle(spark, str(tmp_path / "b")).pipeline.transform(first)
    assert both.agg(F.max(F.abs(F.col("before") - F.col("bayesian_ridge")))).first()[0] == 0


def test_split_and_fold_shares(items):
    rows = preparation.with_fold(preparation.with_split(items, ITEM_KEY), ITEM_KEY)
    shares = {r["split"]: r["count"] / items.count() for r in rows.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.6) < 0.03 and abs(shares["test"] - 0.2) < 0.03
    folds = {r["fold"]: r["count"] / items.count() for r in rows.groupBy("fold").count().collect()}
    assert sorted(folds) == [0, 1, 2, 3, 4] and max(folds.values()) < 0.23
    again = preparation.with_split(items.repartition(7), ITEM_KEY).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in again} == {k: round(v * items.count()) for k, v in shares.items()}


def test_scaling_and_imputing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (10.0, 5.0)], "x double, c double")
    filled = preparation.median_impute(df, ["x"]).collect()
    assert [r["x"] for r in filled] == [1.0, 2.0, 2.0, 10.0]
    scaled = preparation.robust_scale(df, ["x", "c"]).collect()
    assert [r["c_scaled"] for r in scaled] == [0.0] * 4
    np.testing.assert_allclose([scaled[i]["x_scaled"] for i in (0, 1, 3)], [-1 / 4.5, 0, 8 / 4.5])


@pytest.fixture(scope="module")
def small(items):
    return items.select(*CATEGORICAL, *NUMERIC, TARGET, *[c for c in ITEM_ORDER if c not in (*NUMERIC, TARGET)])


@pytest.fixture(scope="module")
def prepared(small):
    return forecast.prepare(small, trailing=False)


def test_preparation_equals_pandas(small, prepared, frame):
    """z-scores and percentiles come from the training rows only."""
    train = prepared.rows.where("split = 'train'").toPandas()
    rows = prepared.preparation.transform(prepared.rows.where("split = 'test'")).toPandas()
    mean, std = train["quantity"].mean(), train["quantity"].std()
    np.testing.assert_allclose(rows["quantity_zscore"], (rows["quantity"] - mean) / (std + 1e-8), rtol=1e-9)
    ranks = dict(zip(train["quantity"], train["quantity"].rank(pct=True)))
    np.testing.assert_allclose(rows["quantity_percentile"], rows["quantity"].map(ranks), rtol=1e-9)
    exact = (train["benefit"].to_numpy()[None, :] <= rows["benefit"].to_numpy()[:, None]).mean(1)
    assert np.abs(rows["benefit_percentile"] - exact).max() < 0.02


def test_unknown_and_missing_values_get_zeros(spark, small, prepared):
    row = small.limit(1).drop(TARGET).withColumns(
        {"market": F.lit("ATLANTIS"), "type": F.lit(None).cast("string"), "benefit": F.lit(None).cast("double")}
    )
    vector = prepared.preparation.transform(row.withColumn(TARGET, F.lit(0.0)))
    values = dict(zip(prepared.names, vector.select(vector_to_array("features").alias("v")).first()["v"]))
    for prefix in ("market", "type"):
        assert sum(v for n, v in values.items() if n.startswith(f"{prefix}_onehot")) == 0
    assert sum(v for n, v in values.items() if n.startswith("customer_segment_onehot")) == 1
    assert values["benefit_scaled"] == 0.0
    assert len(values) == len(prepared.names)


def test_only_the_best_features_are_kept(prepared):
    train = prepared.rows.where("split = 'train'")
    few = preparation.fit_preparation(train, trailing=False, best=6)
    names = preparation.feature_names(few.transform(train))
    assert len(names) == 6 and set(names) <= set(prepared.names)
    assert any("sales_per_customer" in n for n in names)


def test_forecaster_round_trip_and_stream(spark, small, prepared, tmp_path):
    train = prepared.part("train").select("features", TARGET, "fold").persist()
    fitted = models.fit_forecaster(train, prepared.part("validation"), LINEAR, sizes=TINY, primary="ridge")
    bundle = bundles.Bundle(
        PipelineModel([*prepared.preparation.stages, *fitted.stages]), training_metadata(small, [*CATEGORICAL, *NUMERIC])
    )
    assert not bundle.needs_order
    bundles.save_bundle(bundle, str(tmp_path / "bundle"))
    loaded = bundles.load_bundle(spark, str(tmp_path / "bundle"))
    assert loaded.metadata.first()["n_samples"] == small.count()

    want = forecast.score_table(bundle, small, names=LINEAR)
    got = forecast.score_table(loaded, small, names=LINEAR)
    columns = [*ITEM_KEY, *LINEAR, "prediction", "combined", "uncertainty", "lower", "upper"]
    want, got = (t.select(*columns).toPandas().sort_values(columns).to_numpy() for t in (want, got))
    np.testing.assert_allclose(got, want, rtol=1e-9)

    share = evaluation.interval_coverage(forecast.score_table(loaded, small, names=LINEAR), TARGET, "prediction", "sigma").first()
    assert 0.3 < share["coverage_80"] <= share["coverage_95"] <= 1

    known = bundles.known_values(loaded.pipeline)
    assert known["market"] == sorted(known["market"]) and set(known) == set(CATEGORICAL)
    assert set(bundles.unseen_values(small, known).first().asDict().values()) == {0}
    with pytest.raises(ValueError, match="market"):
        bundles.score(loaded, small.drop("market"))

    source = small.drop(TARGET)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scorer.scored_stream(loaded, scorer.arriving_rows(spark, str(tmp_path / "in"), source.schema), LINEAR)
    for _ in range(2):  # the second run finds nothing new
        scorer.score_arriving_files(
            stream, columns, str(tmp_path / "out"), str(tmp_path / "checkpoint")
        ).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(columns).to_numpy()
    np.testing.assert_allclose(streamed, want, rtol=1e-9)


def test_missing_metadata_is_tolerated(spark, prepared, tmp_path):
    bundles.save_bundle(bundles.Bundle(prepared.preparation), str(tmp_path / "b"))
    assert bundles.load_bundle(spark, str(tmp_path / "b")).metadata is None


def test_trailing_means_are_refused_on_streams(spark, small):
    with_means = forecast.prepare(small)
    assert any(n.startswith("benefit_ma") for n in with_means.names)
    bundle = bundles.Bundle(with_means.preparation)
    assert bundle.needs_order
    with pytest.raises(ValueError, match="trailing"):
        scorer.scored_stream(bundle, small)


def test_training_job(spark, small):
    trained = forecast.train(small, names=["ridge", "gradient_boosting"], sizes=TINY, folds=2)
    metrics = trained.metrics.first().asDict()
    assert metrics["r2"] > 0.5 and metrics["rmse"] ** 2 == pytest.approx(metrics["mse"])
    assert metrics["coverage_80"] <= metrics["coverage_95"]
    assert trained.fold_r2.count() == 2
    importance = trained.importance.toPandas()
    np.testing.assert_allclose(importance["combined"], (importance["forest"] + importance["boosted"]) / 2)
    assert importance["forest"].sum() == pytest.approx(1)


# ---- scores and metrics


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=50) * 10 + 100
    rows = [(i, float(v), *(float(v + e) for e in rng.normal(size=3))) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "id int, actual double, m1 double, m2 double, m3 double").persist()


def test_combination_equals_numpy(predictions):
    names = ["m1", "m2", "m3"]
    got = scoring.combine_predictions(predictions, names).toPandas()
    parts = got[names].to_numpy()
    np.testing.assert_allclose(got["combined"], parts.mean(1))
    assert parts.std(1).mean() < 10
    np.testing.assert_allclose(got["uncertainty"], np.maximum(parts.std(1), 25))
    np.testing.assert_allclose(got["upper"] - got["combined"], 1.96 * got["uncertainty"])
    far = predictions.withColumn("m3", F.col("m3") + 1000)
    wide = scoring.with_uncertainty(far, names).toPandas()
    np.testing.assert_allclose(wide["uncertainty"], wide[names].to_numpy().std(1))
    weighted = predictions.select(scoring.weighted_ensemble({"m1": 1.0, "m2": 3.0}).alias("w")).toPandas()["w"]
    np.testing.assert_allclose(weighted, (got["m1"] + 3 * got["m2"]) / 4)


def test_r_squared_of_special_targets(spark):
    def score(rows):
        df = spark.createDataFrame(rows, "a double, p double")
        return df.agg(evaluation.r_squared(F.col("a"), F.col("p"))).first()[0]

    assert score([(1.0, 1.0), (1.0, 1.0)]) == 1.0
    assert score([(1.0, 1.0), (1.0, 2.0)]) == 0.0
    assert score([(1.0, 1.0)]) is None
    assert score([(1.0, 1.0), (3.0, 2.0)]) == 0.5


def test_no_conditions_keep_all(predictions):
    assert predictions.where(all_of([])).count() == 50
