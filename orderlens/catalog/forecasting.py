"""Queries on features, preparation, models, intervals and metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from orderlens.catalog.base import (
    ITEM_ORDER_SQL,
    MODELS,
    closed_form_models,
    gaps,
    md5_bucket,
    on_gaps,
    on_items,
    on_scored,
    query,
    rounded,
)
from orderlens.columns import FEATURES, ITEM_KEY, ITEM_ORDER, NUMERIC
from orderlens.functions.expressions import REPORT_BANDS, confidence_band
from orderlens.operators import categories, evaluation, features, ordered, paging, scoring
from orderlens.plans import bundle as bundles
from orderlens.plans import folds, forecast, models, preparation, trees
from orderlens.plans.growth import Growth
from orderlens.session import scratch_path
from orderlens.sources import files
from orderlens.sources.order_items import order_items

_KEY = ", ".join(ITEM_KEY)
_VIEW = [*FEATURES, "sales", "ts", *ITEM_KEY]

# The library's own tree counts.
SIZES = models.Sizes()


# ---- features


@query(
    on_gaps(
        f"SELECT {_KEY}, "
        + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE)) / n_{c} END AS {c}_percentile"
            for c in NUMERIC
        )
        + " FROM gaps, counts",
        "counts AS (SELECT " + ", ".join(f"CAST(count({c}) AS DOUBLE) AS n_{c}" for c in NUMERIC) + " FROM gaps)",
    )
)
def percentile_ranks(spark, folder):
    """Ties at their average rank, missing values stay missing."""
    table = gaps(spark, folder, [*ITEM_KEY, *NUMERIC])
    ranked = ordered.percentile_rank(table, NUMERIC, spread_by=ITEM_KEY)
    return ranked.select(*ITEM_KEY, *[f"{c}_percentile" for c in NUMERIC])


@query(
    on_gaps(
        f"SELECT {_KEY}, "
        + ", ".join(f"round(({c} - m_{c}) / (s_{c} + 1e-8), 5) AS {c}_zscore" for c in NUMERIC)
        + " FROM gaps, stats",
        "stats AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NUMERIC) + " FROM gaps)",
    )
)
def z_scores(spark, folder):
    """W2"""
    scored = features.zscores(gaps(spark, folder, [*ITEM_KEY, *NUMERIC]), NUMERIC)
    names = [f"{c}_zscore" for c in NUMERIC]
    return rounded(scored.select(*ITEM_KEY, *names), {c: 5 for c in names})


@query(
    on_items(
        f"SELECT {_KEY}, "
        + ", ".join(
            f"round(avg({c}) OVER (ORDER BY {ITEM_ORDER_SQL} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 7) AS {c}_ma"
            for c in [*NUMERIC, "gappy"]
        )
        + " FROM (SELECT * REPLACE (CASE WHEN days_sched <> 3 THEN quantity END AS gappy) FROM (SELECT *, quantity AS gappy FROM items))"
    )
)
def trailing_means(spark, folder):
    """Missing values are skipped inside the window."""
    items = order_items(spark, folder, list(dict.fromkeys([*ITEM_ORDER, *NUMERIC])))
    table = items.withColumn("gappy", F.when(F.col("days_sched") != 3, F.col("quantity")))
    means = ordered.trailing_mean(table, [*NUMERIC, "gappy"], ITEM_ORDER)
    names = [f"{c}_ma" for c in [*NUMERIC, "gappy"]]
    return rounded(means.select(*ITEM_KEY, *names), {c: 7 for c in names})


@query(
    on_items(
        f"SELECT {_KEY}, "
        + ", ".join(f"{c} * {c} AS {c}_squared, round(ln(1 + abs({c})), 10) AS {c}_log" for c in NUMERIC)
        + ", sales_per_customer * quantity AS sales_quantity_interaction, "
        "days_real / (benefit + 1e-8) AS shipping_benefit_ratio FROM items"
    )
)
def row_features(spark, folder):
    """W4, W5, W6, W7"""
    table = features.interaction_features(order_items(spark, folder, [*ITEM_KEY, *NUMERIC]), NUMERIC)
    made = [f"{c}_{kind}" for c in NUMERIC for kind in ("squared", "log")]
    made += ["sales_quantity_interaction", "shipping_benefit_ratio"]
    return rounded(table.select(*ITEM_KEY, *made), {f"{c}_log": 10 for c in NUMERIC})


@query(
    on_items(
        f"SELECT {_KEY}, (rank() OVER (ORDER BY sales_per_customer) "
        "+ (count(*) OVER (PARTITION BY sales_per_customer) - 1) / CAST(2 AS DOUBLE)) / n AS sales_per_customer_percentile, "
        "round((sales_per_customer - m) / (s + 1e-8), 5) AS sales_per_customer_zscore, "
        f"round(avg(sales_per_customer) OVER (ORDER BY {ITEM_ORDER_SQL} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 7) "
        "AS sales_per_customer_ma FROM items, stats",
        "stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(sales_per_customer) AS m, stddev_samp(sales_per_customer) AS s FROM items)",
    )
)
def statistical_features(spark, folder):
    """W1, W2 and W3 together."""
    table = order_items(spark, folder, [*ITEM_ORDER, "sales_per_customer"])
    made = features.statistical_features(table, ["sales_per_customer"], ITEM_ORDER)
    names = [f"sales_per_customer_{kind}" for kind in ("percentile", "zscore", "ma")]
    return rounded(made.select(*ITEM_KEY, *names), {names[1]: 5, names[2]: 7})


# ---- preparation


@query(
    on_items("SELECT market, CASE WHEN market <> 'ASIA' THEN count(*) ELSE 0 END AS n FROM items GROUP BY market")
)
def one_hot_market(spark, folder):
    """M1: fitted without Asia, so its rows get zeros only."""
    items = order_items(spark, folder, ["market"])
    seen = items.where("market <> 'ASIA'")
    indexer = StringIndexer(
        inputCol="market", outputCol="market_index", handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(seen)
    encoder = OneHotEncoder(inputCol="market_index", outputCol="market_onehot", dropLast=True).fit(indexer.transform(seen))
    rows = PipelineModel([indexer, encoder]).transform(items)
    hot = F.array(*[F.lit(v) for v in indexer.labels])
    ones = rows.select("market", F.posexplode(vector_to_array("market_onehot")).alias("position", "one"))
    same = F.element_at(hot, F.col("position") + 1) == F.col("market")
    counted = ones.groupBy("market").agg(
        F.sum(F.when(same, F.col("one")).otherwise(F.lit(0.0))).alias("own"), F.sum("one").alias("all")
    )
    return counted.select("market", F.when(F.col("own") == F.col("all"), F.col("own").cast("bigint")).alias("n"))


@query(
    on_gaps(
        f"SELECT {_KEY}, round(coalesce(benefit, (SELECT quantile_cont(benefit, 0.5) FROM gaps)), 6) AS benefit, quantity FROM gaps"
    )
)
def median_imputed(spark, folder):
    """M2"""
    filled = preparation.median_impute(gaps(spark, folder, [*ITEM_KEY, "benefit", "quantity"]), ["benefit", "quantity"])
    return rounded(filled, {"benefit": 6})


@query(
    on_items(
        f"SELECT {_KEY}, "
        + ", ".join(f"round(({c} - b_{c}) / (c_{c} - a_{c}), 6) AS {c}_scaled" for c in NUMERIC)
        + ", 0.0::DOUBLE AS constant_scaled FROM items, quarters",
        "quarters AS (SELECT "
        + ", ".join(
            f"quantile_cont({c}, {q}) AS {n}_{c}" for c in NUMERIC for n, q in (("a", 0.25), ("b", 0.5), ("c", 0.75))
        )
        + " FROM items)",
    )
)
def robust_scaled(spark, folder):
    """M3: a column without spread scales by one."""
    items = order_items(spark, folder, [*ITEM_KEY, *NUMERIC]).withColumn("constant", F.lit(7.0))
    names = [*NUMERIC, "constant"]
    scaled = preparation.robust_scale(items, names).select(*ITEM_KEY, *[f"{c}_scaled" for c in names])
    return rounded(scaled, {f"{c}_scaled": 6 for c in names})


def _split_sql(columns=ITEM_KEY):
    bucket = md5_bucket(columns, 100, 42)
    return f"CASE WHEN {bucket} < 60 THEN 'train' WHEN {bucket} < 80 THEN 'validation' ELSE 'test' END"


@query(on_items(f"SELECT {_KEY}, {_split_sql()} AS split FROM items"))
def split_assignment(spark, folder):
    """M7"""
    return preparation.with_split(order_items(spark, folder, ITEM_KEY), ITEM_KEY)


@query(on_items(f"SELECT {_KEY}, {md5_bucket(ITEM_KEY, 5, 43)} AS fold FROM items"))
def fold_assignment(spark, folder):
    """M8"""
    return preparation.with_fold(order_items(spark, folder, ITEM_KEY), ITEM_KEY)


_F_SCORES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, sales) AS r, count(*) AS n FROM items" for c in NUMERIC
)


@query(
    on_items(
        f"SELECT feature, round(r * r / (1 - r * r) * (n - 2), 3) AS f_score FROM ({_F_SCORES})"
    )
)
def feature_f_scores(spark, folder):
    """M5"""
    scores = evaluation.f_scores(order_items(spark, folder, [*NUMERIC, "sales"]), NUMERIC, "sales")
    return rounded(scores, {"f_score": 3})


@query(
    on_items(
        f"SELECT feature, count(*) AS n FROM (SELECT feature FROM ({_F_SCORES}) ORDER BY r * r DESC LIMIT 3), items GROUP BY feature"
    )
)
def select_best_features(spark, folder):
    """M6: the three best of five by F score."""
    # the selector passes over the rows twice and the count once: the joins run for the first pass only
    items = files.keep_for_reuse(order_items(spark, folder, [*NUMERIC, "sales"]))
    rows = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(items)
    selector = preparation.best_features("features", "sales", "best", 3).fit(rows)
    picked = [NUMERIC[i] for i in selector.selectedFeatures]
    return items.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in picked])).alias("feature"), "n")


def _prepared(spark, folder, trailing=True):
    return forecast.prepare(order_items(spark, folder, _VIEW), trailing=trailing)


@query(on_items(f"SELECT split, count(*) AS n FROM (SELECT {_split_sql()} AS split FROM items) GROUP BY split"))
def prepared_rows(spark, folder):
    """M4: every row of every split gets a complete feature vector."""
    prepared = _prepared(spark, folder)
    rows = prepared.preparation.transform(prepared.rows)
    size = len(prepared.names)
    filled = F.size(F.filter(vector_to_array("features"), lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.where(filled == size).groupBy("split").agg(F.count("*").alias("n"))


# ---- models


def _fit_and_judge(spark, folder, names):
    """Fit the named models on the training rows and judge each on the test rows."""
    prepared = _prepared(spark, folder)
    train = files.keep_for_reuse(prepared.part("train").select("features", "sales"))
    fitted = PipelineModel(models.fit_models(train, names, sizes=SIZES))
    tested = fitted.transform(prepared.part("test"))
    parts = [
        F.struct(
            F.lit(n).alias("model"),
            F.avg(F.abs(F.col("sales") - F.col(n))).alias("mae"),
            evaluation.r_squared(F.col("sales"), F.col(n)).alias("r2"),
        )
        for n in names
    ]
    return tested.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


@query()
def tree_models(spark, folder):
    """R1, R2, R3"""
    return _fit_and_judge(spark, folder, models.MODEL_NAMES[:3])


@query()
def linear_models(spark, folder):
    """R4, R5, R6"""
    return _fit_and_judge(spark, folder, models.MODEL_NAMES[3:])


def _one_feature(spark, folder):
    items = order_items(spark, folder, ["quantity", "sales"])
    return files.keep_for_reuse(VectorAssembler(inputCols=["quantity"], outputCol="features").transform(items))


@query(
    on_items(
        "SELECT round(w, 6) AS coefficient, round(my - w * mx, 4) AS intercept, n FROM ("
        "SELECT regr_sxy(sales, quantity) / (regr_sxx(sales, quantity) + 1.0) AS w, avg(sales) AS my, "
        "avg(quantity) AS mx, count(*) AS n FROM items)"
    )
)
def ridge_line(spark, folder):
    """R5 with one feature, where it has a closed form."""
    rows = _one_feature(spark, folder)
    n, sd = models.label_stats(rows)
    fit = models.ridge(n, sd).fit(rows)
    return rounded(
        rows.agg(
            F.lit(float(fit.coefficients[0])).alias("coefficient"),
            F.lit(fit.intercept).alias("intercept"),
            F.count("*").alias("n"),
        ),
        {"coefficient": 6, "intercept": 4},
    )


@query(
    on_items(
        "SELECT round(w, 6) AS coefficient, round(my - w * mx, 4) AS intercept, n FROM ("
        "SELECT sign(z) * greatest(abs(z) - 0.05, 0) / (v + 0.05) AS w, my, mx, n FROM ("
        "SELECT covar_pop(sales, quantity) AS z, var_pop(quantity) AS v, avg(sales) AS my, avg(quantity) AS mx, "
        "count(*) AS n FROM items))"
    )
)
def elastic_net_line(spark, folder):
    """R4 with one feature, where it has a closed form."""
    rows = _one_feature(spark, folder)
    fit = models.elastic_net(models.label_stats(rows)[1]).fit(rows)
    return rounded(
        rows.agg(
            F.lit(float(fit.coefficients[0])).alias("coefficient"),
            F.lit(fit.intercept).alias("intercept"),
            F.count("*").alias("n"),
        ),
        {"coefficient": 6, "intercept": 4},
    )


@query(
    on_items(
        "SELECT round(xy / (xx + weight / noise), 2) AS coefficient, round(my - xy / (xx + weight / noise) * mx, 1) AS intercept, n "
        "FROM steps, moments WHERE i = 60",
        "moments AS (SELECT count(*) AS n, regr_sxx(sales, quantity) AS xx, regr_sxy(sales, quantity) AS xy, "
        "regr_syy(sales, quantity) AS yy, avg(sales) AS my, avg(quantity) AS mx FROM items)",
        "steps AS (SELECT 0 AS i, 1.0::DOUBLE AS weight, n / yy AS noise FROM moments UNION ALL "
        "SELECT i + 1, (used + 2e-6) / (c * c + 2e-6), (n - used + 2e-6) / (yy - 2 * c * xy + c * c * xx + 2e-6) FROM ("
        "SELECT i, xy / (xx + weight / noise) AS c, noise * xx / (weight + noise * xx) AS used, n, xx, xy, yy "
        "FROM steps, moments WHERE i < 60))",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def bayesian_ridge_line(spark, folder):
    """R6 with one feature, where the evidence updates need three sums only."""
    rows = _one_feature(spark, folder)
    n, sd = models.label_stats(rows)
    fit = models.bayesian_ridge(rows, n, sd).fit(rows)
    line = rows.agg(
        F.lit(float(fit.coefficients[0])).alias("coefficient"),
        F.lit(fit.intercept).alias("intercept"),
        F.count("*").alias("n"),
    )
    return rounded(line, {"coefficient": 2, "intercept": 1})


def _step(spark, folder):
    """A label that is one value for early and another for late deliveries, and a feature that says nothing."""
    items = order_items(spark, folder, ["days_sched"]).select(
        "days_sched", F.lit(1.0).alias("nothing"), F.when(F.col("days_sched") <= 3, 40.0).otherwise(90.0).alias("sales")
    )
    return files.keep_for_reuse(VectorAssembler(inputCols=["days_sched", "nothing"], outputCol="features").transform(items))


@query(
    on_items(
        " UNION ALL ".join(
            f"SELECT '{name}' AS model, days_sched, count(*) AS n, CASE WHEN days_sched <= 3 THEN 40.0 ELSE 90.0 END::DOUBLE "
            "AS predicted FROM items GROUP BY days_sched"
            for name in models.MODEL_NAMES[:3]
        )
    )
)
def trees_on_a_step(spark, folder):
    """R1, R2, R3 where the answer is known: each model must find the step, whatever rows its trees draw.

    To two digits: a tree that drew the other feature alone leaves the residuals as they are, and a
    penalised leaf stops pulling once they sum up to the penalty.
    """
    rows, names = _step(spark, folder), models.MODEL_NAMES[:3]
    fitted = PipelineModel(models.fit_models(rows, names, sizes=SIZES)).transform(rows)
    lines = F.array(*[F.struct(F.lit(name).alias("model"), F.round(name, 2).alias("predicted")) for name in names])
    each = fitted.select("days_sched", F.inline(lines))
    return each.groupBy("model", "days_sched", "predicted").agg(F.count("*").alias("n")).select("model", "days_sched", "n", "predicted")


@query(
    on_items(
        "SELECT quantity, days_sched, count(*) AS n, round(any_value(base) + any_value(sign(g) * greatest(abs(g) - 0.1, 0) / (h + 0.1)), 6) AS predicted "
        "FROM leaves GROUP BY quantity, days_sched",
        "marked AS (SELECT quantity, days_sched, CASE WHEN quantity <= 20 THEN CASE WHEN days_sched <= 3 THEN 10.0 ELSE 20.0 END "
        "ELSE CASE WHEN days_sched <= 2 THEN 50.0 ELSE 90.0 END END::DOUBLE AS y FROM items)",
        "leaves AS (SELECT quantity, days_sched, base, sum(y - base) OVER (PARTITION BY y) AS g, count(*) OVER (PARTITION BY y) AS h "
        "FROM marked, (SELECT avg(y) AS base FROM marked))",
    )
)
def penalised_tree(spark, folder):
    """R2: one tree of two levels whose leaves are known, with both leaf penalties."""
    items = order_items(spark, folder, ["quantity", "days_sched"])
    few, late = F.col("quantity") <= 20, F.col("days_sched")
    y = F.when(few, F.when(late <= 3, 10.0).otherwise(20.0)).otherwise(F.when(late <= 2, 50.0).otherwise(90.0))
    rows = VectorAssembler(inputCols=["quantity", "days_sched"], outputCol="features").transform(items.withColumn("y", y))
    growth = Growth(1, 2, rate=1.0, l1=models.LEAF_L1, l2=models.LEAF_L2)
    fitted = trees.fit_together(files.keep_for_reuse(rows), {"predicted": growth}, "y")["predicted"]
    each = fitted.transform(rows).groupBy("quantity", "days_sched", F.round("predicted", 6).alias("predicted"))
    return each.agg(F.count("*").alias("n")).select("quantity", "days_sched", "n", "predicted")


@query(
    on_items(
        "SELECT feature, row_number() OVER (ORDER BY v DESC) AS place, n FROM (SELECT unnest(['days_sched', 'quantity', 'days_real']) AS feature, "
        "unnest([var_pop(100.0 * (days_sched > 3)::INT), var_pop(40.0 * (quantity > 25)::INT), var_pop(10.0 * (days_real > 0)::INT)]) AS v, "
        "count(*) AS n FROM items)"
    )
)
def importance_order(spark, folder):
    """R16 where three features add up: the more of the variance a feature makes, the more important it is, to both models."""
    names = ["days_sched", "quantity", "days_real"]
    above = lambda name, mark, size: F.when(F.col(name) > mark, float(size)).otherwise(0.0)
    items = order_items(spark, folder, names)
    y = above("days_sched", 3, 100) + above("quantity", 25, 40) + above("days_real", 0, 10)
    rows = files.keep_for_reuse(VectorAssembler(inputCols=names, outputCol="features").transform(items.withColumn("sales", y)))
    found = {r["feature"]: r for r in models.feature_importance(rows, names, trees=SIZES.importance_trees).collect()}
    orders = [sorted(names, key=lambda name: -found[name][by]) for by in ("forest", "boosted", "combined")]
    if orders[0] != orders[1]:
        raise ValueError(f"the models disagree: {orders}")
    n = rows.count()
    return spark.createDataFrame([(name, place, n) for place, name in enumerate(orders[2], 1)], "feature string, place long, n long")


@query(
    on_items(
        "SELECT feature, forest, boosted, combined, count(*) AS n FROM items, (VALUES "
        "('days_sched', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('nothing', 0.0, 0.0, 0.0)) AS v(feature, forest, boosted, combined) GROUP BY ALL"
    )
)
def importance_of_one_feature(spark, folder):
    """R16 where one feature explains everything and the other is constant."""
    rows = _step(spark, folder)
    found = models.feature_importance(rows, ["days_sched", "nothing"], trees=SIZES.importance_trees)
    scores = F.struct(*[F.round(c, 6).alias(c) for c in ("forest", "boosted", "combined")])
    return found.select("feature", scores.alias("s"), F.lit(rows.count()).alias("n")).select("feature", "s.*", "n")


@query(on_items("SELECT days_sched, round(8 * sqrt(pi() / 2), 6) AS sigma, count(*) AS n FROM items GROUP BY days_sched"))
def sigma_of_constant_errors(spark, folder):
    """R14 where every prediction is off by 8: the error model must say so for every row."""
    rows = _step(spark, folder).withColumn("prediction", F.col("sales") + F.when(F.col("days_sched") % 2 == 0, 8.0).otherwise(-8.0))
    scored = models.interval_stage().transform(models.fit_sigma(rows, rounds=SIZES.rounds).transform(rows))
    return scored.groupBy("days_sched", F.round("sigma", 6).alias("sigma")).agg(F.count("*").alias("n"))


@query(
    on_items(
        "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 2) AS f_score FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, sales) AS r, count(*) AS n FROM items" for c in NUMERIC if c != "sales_per_customer")
        + ") ORDER BY f_score DESC, feature LIMIT 2"
    )
)
def top_features_by_f_score(spark, folder):
    """L4: the first features by score."""
    names = [c for c in NUMERIC if c != "sales_per_customer"]
    scores = evaluation.f_scores(order_items(spark, folder, [*names, "sales"]), names, "sales")
    return rounded(paging.top_features(scores, "f_score", 2), {"f_score": 2})


@query()
def forecast_test_rows(spark, folder):
    """The whole forecaster, all members, on the test rows, ridge as the primary model."""
    prepared = _prepared(spark, folder)
    train = files.keep_for_reuse(prepared.part("train").select("features", "sales"))
    fitted = models.fit_forecaster(train, prepared.part("validation"), models.MODEL_NAMES, sizes=SIZES, primary="ridge")
    tested = fitted.transform(prepared.part("test"))
    return tested.select(*ITEM_KEY, "sales", "ensemble", "prediction", "sigma", "prediction_lower", "prediction_upper")


@query()
def forest_cross_validation(spark, folder):
    """R15"""
    prepared = _prepared(spark, folder, trailing=False)
    train = files.keep_for_reuse(prepared.part("train").select("features", "sales", "fold"))
    return models.cross_validate(train, preparation.FOLDS, trees=SIZES.fold_trees)


@query(
    on_items(
        "SELECT round(avg(r2), 8) AS cv_mean, round(stddev_pop(r2), 8) AS cv_std FROM ("
        "SELECT fold, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM ("
        "SELECT fold, sales AS y, a * sales_per_customer + b AS p FROM folded JOIN lines USING (fold)) GROUP BY fold)",
        f"folded AS (SELECT sales, sales_per_customer, {md5_bucket(ITEM_KEY, 5, 43)} AS fold FROM items)",
        "lines AS (SELECT k AS fold, regr_slope(sales, sales_per_customer) AS a, regr_intercept(sales, sales_per_customer) AS b "
        "FROM folded, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k)",
    )
)
def linear_cross_validation(spark, folder):
    """R15 for a fitted line, which SQL can state as well."""
    rows = preparation.with_fold(order_items(spark, folder, [*ITEM_KEY, "sales", "sales_per_customer"]), ITEM_KEY)
    scores = evaluation.linear_cross_validation(rows, "sales", "sales_per_customer", preparation.FOLDS)
    return rounded(evaluation.fold_summary(scores), {"cv_mean": 8, "cv_std": 8})


_LEVELS_SQL = """LEVELS_OF AS (
  SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM (
    SELECT coalesce(CAST(NAME AS VARCHAR), '__null__') AS value FROM coded GROUP BY 1 HAVING count(*) >= 5)
)"""


@query(
    on_items(
        f"SELECT {_KEY}, coalesce(p.idx, (SELECT count(*) FROM part_levels)) AS part_index, "
        "coalesce(m.idx, (SELECT count(*) FROM market_levels)) AS market_index FROM coded "
        "LEFT JOIN part_levels p ON p.value = coded.part LEFT JOIN market_levels m ON m.value = coalesce(coded.market, '__null__')",
        "coded AS (SELECT *REPLACE (CASE WHEN market <> 'ASIA' THEN market END AS market), "
        "'p' || CAST(part_id AS VARCHAR) AS part FROM items)",
        _LEVELS_SQL.replace("LEVELS_OF", "part_levels").replace("NAME", "part"),
        _LEVELS_SQL.replace("LEVELS_OF", "market_levels").replace("NAME", "market"),
    )
)
def category_levels(spark, folder):
    """M1 for columns of any number of values: a stored dictionary, rare values (below five rows) share a level."""
    items = order_items(spark, folder, [*ITEM_KEY, "market"])
    coded = items.withColumns(
        {"part": F.concat(F.lit("p"), F.col("part_id").cast("string")), "market": F.when(F.col("market") != "ASIA", F.col("market"))}
    )
    path = scratch_path(spark, "dictionary")
    categories.save_dictionary(categories.learn_dictionary(coded, ["part", "market"], 5), path)
    found = categories.with_levels(coded, categories.load_dictionary(spark, path), ["part", "market"])
    return found.select(*ITEM_KEY, "part_index", "market_index")


_FOLD_SUMS = """folded AS (SELECT sales AS y, quantity AS a, benefit AS b, FOLD AS fold FROM items),
parts AS (
  SELECT k AS fold, y, a, b, fold = k AS held FROM folded, (SELECT unnest(range(5)) AS k)
), train AS (
  SELECT fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb,
         covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb
  FROM parts WHERE NOT held GROUP BY fold
), penalties AS (
  SELECT fold, 'ridge' AS model, 1.0 / n AS l2, 0.0 AS l1 FROM train
  UNION ALL SELECT fold, 'elastic_net', 0.05, 0.05 FROM train
), signed AS (
  SELECT *, (aa + l2) * (bb + l2) - ab * ab AS det,
         sign(ay * (bb + l2) - yb * ab) AS sa, sign(yb * (aa + l2) - ay * ab) AS sb
  FROM train JOIN penalties USING (fold)
), lines AS (
  SELECT fold, model, ((ay - l1 * sa) * (bb + l2) - (yb - l1 * sb) * ab) / det AS wa,
         ((yb - l1 * sb) * (aa + l2) - (ay - l1 * sa) * ab) / det AS wb, ma, mb, my
  FROM signed
)""".replace("FOLD", md5_bucket(ITEM_KEY, 5, 43))


@query(
    on_items(
        "SELECT model, fold, round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) AS r2 FROM ("
        "SELECT model, fold, y, my + wa * (a - ma) + wb * (b - mb) AS p FROM parts JOIN lines USING (fold) WHERE held"
        ") GROUP BY model, fold",
        _FOLD_SUMS,
    )
)
def penalised_line_cross_validation(spark, folder):
    """Both penalised members of two features; neither weight is driven to zero here, so SQL can solve them."""
    items = order_items(spark, folder, [*ITEM_KEY, "sales", "quantity", "benefit"])
    rows = VectorAssembler(inputCols=["quantity", "benefit"], outputCol="features").transform(preparation.with_fold(items, ITEM_KEY))
    return rounded(folds.linear_scores(rows, preparation.FOLDS, ["ridge", "elastic_net"]), {"r2": 8})


@query()
def linear_members_cross_validation(spark, folder):
    """All linear members on all prepared features, all folds from one set of products."""
    train = files.keep_for_reuse(_prepared(spark, folder, trailing=False).part("train").select("features", "sales", "fold"))
    return folds.linear_scores(train, preparation.FOLDS)


@query()
def feature_importances(spark, folder):
    """R16, L4"""
    prepared = _prepared(spark, folder)
    train = files.keep_for_reuse(prepared.part("train").select("features", "sales"))
    return paging.top_features(
        models.feature_importance(train, prepared.names, trees=SIZES.importance_trees), "combined"
    )


@query(on_items("SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM items"))
def saved_and_loaded_model(spark, folder):
    """SNK5, SNK6: the loaded bundle, preparation and all linear members, predicts the same from the raw rows."""
    names = models.MODEL_NAMES[3:]
    prepared = _prepared(spark, folder, trailing=False)
    train = files.keep_for_reuse(prepared.part("train").select("features", "sales"))
    pipeline = PipelineModel([*prepared.preparation.stages, *models.fit_models(train, names)])
    train.unpersist()
    path = scratch_path(spark, "bundle")
    bundles.save_bundle(bundles.Bundle(pipeline), path)
    first = bundles.score(bundles.Bundle(pipeline), prepared.rows)
    first = first.select(*prepared.rows.columns, *[F.col(n).alias(f"before_{n}") for n in names])
    both = bundles.score(bundles.load_bundle(spark, path), first)
    off = F.greatest(*[F.abs(F.col(f"before_{n}") - F.col(n)) for n in names])
    return both.agg(F.count("*").alias("n"), F.max(off).alias("largest_difference"))


# ---- scores and intervals, on closed-form models


def _models(spark, folder, *columns):
    return closed_form_models(spark, folder, [*ITEM_KEY, *columns])


@query(
    on_items(
        "SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 2) AS mse, "
        "round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) AS r2 "
        "FROM scored WHERE y IS NOT NULL AND p IS NOT NULL",
        "lines AS (SELECT regr_slope(sales, quantity) AS a, regr_intercept(sales, quantity) AS b FROM items)",
        "scored AS (SELECT CASE WHEN quantity <> 13 THEN sales END AS y, "
        "CASE WHEN days_sched <> 3 THEN a * quantity + b END AS p FROM items, lines)",
    )
)
def error_metrics_with_gaps(spark, folder):
    """R17 where some rows have no target and others no prediction: every term is over the complete pairs."""
    items = order_items(spark, folder, ["quantity", "sales", "days_sched"])
    line = items.agg(
        F.struct(F.regr_slope("sales", "quantity").alias("a"), F.regr_intercept("sales", "quantity").alias("b")).alias("line")
    ).scalar()
    rows = items.select(
        F.when(F.col("quantity") != 13, F.col("sales")).alias("y"),
        F.when(F.col("days_sched") != 3, line["a"] * F.col("quantity") + line["b"]).alias("p"),
    )
    return rounded(evaluation.error_metrics(rows, "y", "p").select("mae", "mse", "r2"), {"mae": 4, "mse": 2, "r2": 8})


@query(
    on_scored(f"SELECT {_KEY}, round((2 * m_group + m_line + m_quantity) / 4.0, 2) AS ensemble FROM scored")
)
def weighted_ensemble(spark, folder):
    """R7"""
    weights = dict(zip(MODELS, (2.0, 1.0, 1.0)))
    scored = _models(spark, folder).select(*ITEM_KEY, scoring.weighted_ensemble(weights).alias("ensemble"))
    return rounded(scored, {"ensemble": 2})


@query(
    on_scored(
        f"SELECT {_KEY}, round(b, 2) AS blended, round(b - 1.96 * sigma, 2) AS lower, round(b + 1.96 * sigma, 2) AS upper "
        "FROM (SELECT *, 0.6 * m_line + 0.4 * combined AS b FROM scored)"
    )
)
def blend_with_interval(spark, folder):
    """R8, R9"""
    blended = scoring.blend(F.col("m_line"), scoring.combined_mean(MODELS))
    rows = _models(spark, folder).withColumn("blended", blended)
    lower, upper = scoring.interval(F.col("blended"), F.col("sigma"))
    return rounded(
        rows.select(*ITEM_KEY, "blended", lower.alias("lower"), upper.alias("upper")),
        {"blended": 2, "lower": 2, "upper": 2},
    )


@query(
    on_scored(
        f"SELECT {_KEY}, round(combined, 2) AS combined, round(spread, 2) AS spread, "
        "round((m_group + m_line + m_quantity + combined) / 4.0, 2) AS with_ensemble FROM scored"
    )
)
def combined_mean_and_spread(spark, folder):
    """R10, R11"""
    rows = _models(spark, folder).withColumn("ensemble", scoring.combined_mean(MODELS))
    return rounded(
        rows.select(
            *ITEM_KEY,
            F.col("ensemble").alias("combined"),
            scoring.model_spread(MODELS).alias("spread"),
            scoring.combined_mean(MODELS, "ensemble", count_ensemble=True).alias("with_ensemble"),
        ),
        {"combined": 2, "spread": 2, "with_ensemble": 2},
    )


@query(on_scored(f"SELECT {_KEY}, round(uncertainty, 2) AS uncertainty FROM scored"))
def uncertainty_with_sigma(spark, folder):
    """R12 where a sigma exists."""
    rows = scoring.with_uncertainty(_models(spark, folder), MODELS, "sigma")
    return rounded(rows.select(*ITEM_KEY, "uncertainty"), {"uncertainty": 2})


@query(
    on_scored(
        f"SELECT {_KEY}, round(CASE WHEN (SELECT avg(spread / 1000) FROM scored) < 10 THEN greatest(spread / 1000, 25) "
        "ELSE spread / 1000 END, 4) AS uncertainty FROM scored"
    )
)
def uncertainty_floor(spark, folder):
    """R12 without a sigma: sales in thousands, where the models agree within the limit."""
    rows = _models(spark, folder).withColumns({m: F.col(m) / 1000 for m in MODELS})
    return rounded(scoring.with_uncertainty(rows, MODELS).select(*ITEM_KEY, "uncertainty"), {"uncertainty": 4})


@query(
    on_scored(
        f"SELECT {_KEY}, round(coalesce(abs(CASE WHEN quantity <> 13 THEN -sigma END), 50.0), 2) AS sigma FROM scored"
    )
)
def default_sigma(spark, folder):
    """R13"""
    given = F.when(F.col("quantity") != 13, -F.col("sigma"))
    return rounded(_models(spark, folder).select(*ITEM_KEY, scoring.default_sigma(given).alias("sigma")), {"sigma": 2})


@query(
    on_scored(
        f"SELECT {_KEY}, CASE WHEN u < 50 THEN 'High' WHEN u < 100 THEN 'Medium' ELSE 'Low' END AS report_band, "
        "CASE WHEN u < 30 THEN 'High' WHEN u < 80 THEN 'Medium' ELSE 'Low' END AS record_band "
        "FROM (SELECT *, uncertainty / 100 AS u FROM scored)"
    )
)
def confidence_bands(spark, folder):
    """Uncertainties in hundreds, so that all bands occur."""
    rows = scoring.with_uncertainty(_models(spark, folder), MODELS, "sigma")
    u = F.col("uncertainty") / 100
    return rows.select(
        *ITEM_KEY, confidence_band(u, REPORT_BANDS).alias("report_band"), confidence_band(u).alias("record_band")
    )


# ---- metrics


@query(
    on_scored(
        "SELECT round(avg(abs(sales - combined)), 3) AS mae, round(avg((sales - combined) * (sales - combined)), 0) AS mse, "
        "round(sqrt(avg((sales - combined) * (sales - combined))), 3) AS rmse, "
        "round(1 - avg((sales - combined) * (sales - combined)) / var_pop(sales), 8) AS r2 FROM scored"
    )
)
def error_metrics(spark, folder):
    """R17"""
    rows = _models(spark, folder).withColumn("combined", scoring.combined_mean(MODELS))
    row = evaluation.error_metrics(rows, "sales", "combined")
    return rounded(row, {"mae": 3, "mse": 0, "rmse": 3, "r2": 8})


@query(
    on_scored(
        "SELECT round(avg(CAST(sales BETWEEN combined - 1.28 * uncertainty AND combined + 1.28 * uncertainty AS INTEGER)), 8) "
        "AS coverage_80, round(avg(CAST(sales BETWEEN lower AND upper AS INTEGER)), 8) AS coverage_95 FROM scored"
    )
)
def interval_coverage(spark, folder):
    """R18"""
    rows = scoring.combine_predictions(_models(spark, folder), MODELS, "sigma")
    row = evaluation.interval_coverage(rows, "sales", "combined", "uncertainty")
    return rounded(row, {"coverage_80": 8, "coverage_95": 8})


_RESILIENCE = (
    "parts AS (SELECT 1 - avg((sales - combined) * (sales - combined)) / var_pop(sales) AS r2, "
    "avg(abs(sales - combined)) AS mae, avg(sales) AS mean_actual, "
    "least(stddev_pop(combined) / (stddev_pop(sales) + 1e-8), 1.0) AS volatility_ratio, "
    "1 - abs(regr_slope(combined, idx) - regr_slope(sales, idx)) / (abs(regr_slope(sales, idx)) + 1e-8) AS trend_similarity "
    f"FROM (SELECT *, CAST(row_number() OVER (ORDER BY {ITEM_ORDER_SQL}) - 1 AS DOUBLE) AS idx FROM scored))"
)


@query(
    on_scored(
        "SELECT round(0.4 * r2 + 0.3 * (1 - mae / (mean_actual + 1e-8)) + 0.2 * volatility_ratio "
        "+ 0.1 * greatest(0, trend_similarity), 6) AS resilience_score, round(r2, 6) AS r2, round(mae, 3) AS mae, "
        "round(volatility_ratio, 6) AS volatility_ratio, round(trend_similarity, 5) AS trend_similarity FROM parts",
        _RESILIENCE,
    )
)
def resilience(spark, folder):
    """R19, R20, R21"""
    rows = closed_form_models(spark, folder, ITEM_ORDER).withColumn("combined", scoring.combined_mean(MODELS))
    row = evaluation.resilience(rows, "sales", "combined", ITEM_ORDER)
    return rounded(
        row, {"resilience_score": 6, "r2": 6, "mae": 3, "volatility_ratio": 6, "trend_similarity": 5}
    )


@query(
    on_scored(
        "SELECT sales AS actual, round(combined, 2) AS predicted, round(lo, 2) AS line_lo, round(hi, 2) AS line_hi "
        "FROM scored, (SELECT least(min(sales), min(combined)) AS lo, greatest(max(sales), max(combined)) AS hi FROM scored)"
    )
)
def actual_and_predicted(spark, folder):
    """R22"""
    rows = _models(spark, folder).withColumn("combined", scoring.combined_mean(MODELS))
    pairs = scoring.actual_predicted(rows, "sales", "combined")
    return rounded(pairs, {"predicted": 2, "line_lo": 2, "line_hi": 2})


@query(
    on_scored(
        'SELECT ts AS "time", sales AS actual, round(combined, 2) AS predicted, round(lower, 2) AS lower, '
        "round(upper, 2) AS upper FROM scored"
    )
)
def forecast_series(spark, folder):
    """R23"""
    rows = scoring.combine_predictions(closed_form_models(spark, folder, ITEM_ORDER), MODELS, "sigma")
    series = scoring.forecast_series(rows, "ts", ITEM_ORDER, "sales")
    return rounded(series, {"predicted": 2, "lower": 2, "upper": 2})


@query(
    on_scored(
        "SELECT CAST(ts AS DATE) AS day, round(avg(sales), 7) AS actual, round(avg(combined), 2) AS predicted, "
        "round(avg(lower), 2) AS lower, round(avg(upper), 2) AS upper, count(*) AS n_rows FROM scored GROUP BY 1"
    )
)
def daily_forecast_series(spark, folder):
    """R23 as daily means."""
    rows = scoring.combine_predictions(closed_form_models(spark, folder, ["ts"]), MODELS, "sigma")
    series = scoring.daily_series(rows, "ts", "sales")
    return rounded(series, {"actual": 7, "predicted": 2, "lower": 2, "upper": 2})

