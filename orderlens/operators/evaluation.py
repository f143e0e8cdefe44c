"""Judging predictions: errors, coverage, resilience, feature scores. One aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import EPSILON, Z80, Z95, one_row_to_long, pearson, quoted
from orderlens.operators.ordered import dense_index

# Weights of the resilience score.
W_R2, W_MAE, W_VOLATILITY, W_TREND = 0.4, 0.3, 0.2, 0.1


def complete(actual: Column, predicted: Column) -> tuple[Column, Column]:
    """Both values where both are there, else NULL, so that every term of a metric is over the same rows."""
    return F.when(predicted.isNotNull(), actual), F.when(actual.isNotNull(), predicted)


def r_squared(actual: Column, predicted: Column) -> Column:
    """1 - SSE/SST; a constant target gives 1 if met exactly, else 0; below two rows NULL."""
    actual, predicted = complete(actual, predicted)
    error = F.avg((actual - predicted) * (actual - predicted))
    spread = F.var_pop(actual)
    return (
        F.when(F.count(actual) < 2, F.lit(None).cast("double"))
        .when(spread == 0, F.when(error == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(error, spread))
    )


def error_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    mse = F.avg((a - p) * (a - p))
    return df.agg(
        F.avg(F.abs(a - p)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), r_squared(a, p).alias("r2")
    )


def coverage_share(actual: Column, predicted: Column, sigma: Column, z: float) -> Column:
    return F.avg(actual.between(predicted - sigma * z, predicted + sigma * z).cast("int"))


def interval_coverage(df: DataFrame, actual: str, predicted: str, sigma: str) -> DataFrame:
    """Shares of rows inside the 80 % and the 95 % interval."""
    a, p, s = F.col(actual), F.col(predicted), F.col(sigma)
    return df.agg(
        coverage_share(a, p, s, Z80).alias("coverage_80"), coverage_share(a, p, s, Z95).alias("coverage_95")
    )


def volatility_ratio(actual: Column, predicted: Column) -> Column:
    return F.least(F.stddev_pop(predicted) / (F.stddev_pop(actual) + EPSILON), F.lit(1.0))


def trend_similarity(actual: Column, predicted: Column, index: Column) -> Column:
    slope_a, slope_p = F.regr_slope(actual, index), F.regr_slope(predicted, index)
    return 1 - F.abs(slope_p - slope_a) / (F.abs(slope_a) + EPSILON)


def resilience(df: DataFrame, actual: str, predicted: str, order: Sequence[str]) -> DataFrame:
    """Resilience score and its parts; the trends run over the rows in the given order.

    The row numbers come from ``dense_index``; everything else is one aggregate over them.
    """
    needed = list(dict.fromkeys([*order, actual, predicted]))
    return resilience_of_indexed(dense_index(df.select(*needed), order, "idx"), actual, predicted, "idx")


def resilience_of_indexed(df: DataFrame, actual: str, predicted: str, index: str) -> DataFrame:
    a, p = complete(F.col(actual).cast("double"), F.col(predicted).cast("double"))
    parts = df.agg(
        r_squared(a, p).alias("r2"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.avg(a).alias("mean_actual"),
        volatility_ratio(a, p).alias("volatility_ratio"),
        trend_similarity(a, p, F.col(index).cast("double")).alias("trend_similarity"),
    )
    score = (
        W_R2 * F.col("r2")
        + W_MAE * (1 - F.col("mae") / (F.col("mean_actual") + EPSILON))
        + W_VOLATILITY * F.col("volatility_ratio")
        + W_TREND * F.greatest(F.lit(0.0), F.col("trend_similarity"))
    )
    return parts.select(score.alias("resilience_score"), "r2", "mae", "volatility_ratio", "trend_similarity")


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Univariate linear F score of every feature, from the correlations of one aggregate."""
    row = df.where(quoted(target).isNotNull()).agg(
        F.count("*").alias("n"), *[pearson(quoted(c), quoted(target)).alias(f"r{i}") for i, c in enumerate(features)]
    )
    rows = []
    for i, name in enumerate(features):
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        rows.append((F.lit(name), F.try_divide(r2, 1 - r2) * (F.col("n") - 2)))
    return one_row_to_long(row, rows, ["feature", "f_score"])


def fold_scores(df: DataFrame, actual: str, predicted: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(fold).agg(r_squared(F.col(actual), F.col(predicted)).alias("r2"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"))


def linear_cross_validation(df: DataFrame, actual: str, feature: str, folds: int, fold: str = "fold") -> DataFrame:
    """R² per fold of a line fitted on the other folds, in one aggregate over the whole table."""
    parts = []
    for k in range(folds):
        outside = F.col(fold) != k
        y, x = F.when(outside, F.col(actual)), F.when(outside, F.col(feature))
        parts += [F.regr_slope(y, x).alias(f"slope{k}"), F.regr_intercept(y, x).alias(f"intercept{k}")]
    lines = df.agg(F.struct(*parts).alias("lines")).scalar()
    predicted = F.lit(None).cast("double")
    for k in range(folds):
        line = lines[f"slope{k}"] * F.col(feature) + lines[f"intercept{k}"]
        predicted = F.when(F.col(fold) == k, line).otherwise(predicted)
    return fold_scores(df.withColumn("predicted", predicted), actual, "predicted", fold)
