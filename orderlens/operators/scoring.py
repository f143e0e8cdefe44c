"""Combining predictions, their spread and their intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import parse_timestamp
from orderlens.functions.expressions import Z95

# Share of the primary model in the blend, sigma of a model that gives none,
# and the floor of the uncertainty where the models agree too well.
PRIMARY_SHARE = 0.6
DEFAULT_SIGMA = 50.0
AGREEMENT_LIMIT = 10.0
UNCERTAINTY_FLOOR = 25.0


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def weighted_ensemble(weights: Mapping[str, float]) -> Column:
    """Weighted mean of prediction columns."""
    total = float(sum(weights.values()))
    return _sum([F.col(c) * F.lit(w / total) for c, w in weights.items()])


def blend(primary: Column, ensemble: Column, share: float = PRIMARY_SHARE) -> Column:
    return primary * share + ensemble * (1 - share)


def interval(prediction: Column, sigma: Column, z: float = Z95) -> tuple[Column, Column]:
    return prediction - sigma * z, prediction + sigma * z


def combined_mean(columns: Sequence[str], ensemble: str | None = None, count_ensemble: bool = False) -> Column:
    """Plain mean of the models. The ensemble is itself their mean, so it takes part only on request."""
    names = [*columns, ensemble] if ensemble and count_ensemble else list(columns)
    return _sum([F.col(c) for c in names]) / float(len(names))


def model_spread(columns: Sequence[str]) -> Column:
    """Population deviation of the models of one row, taken around their mean."""
    middle = combined_mean(columns)
    squares = [(F.col(c) - middle) * (F.col(c) - middle) for c in columns]
    return F.sqrt(_sum(squares) / float(len(columns)))


def default_sigma(sigma: Column | None = None) -> Column:
    """Size of the model's own sigma, or the default where it gives none."""
    return F.coalesce(F.abs(sigma), F.lit(DEFAULT_SIGMA)) if sigma is not None else F.lit(DEFAULT_SIGMA)


def with_uncertainty(
    df: DataFrame, columns: Sequence[str], sigma: str | None = None, name: str = "uncertainty"
) -> DataFrame:
    """Spread of the models, but at least the model's sigma; without one, at least a floor if all agree."""
    spread = model_spread(columns)
    if sigma is not None:
        return df.withColumn(name, F.greatest(spread, F.col(sigma)))
    mean_spread = df.agg(F.avg(spread)).scalar()
    return df.withColumn(
        name, F.when(mean_spread < AGREEMENT_LIMIT, F.greatest(spread, F.lit(UNCERTAINTY_FLOOR))).otherwise(spread)
    )


def combine_predictions(
    df: DataFrame,
    columns: Sequence[str],
    sigma: str | None = None,
    ensemble: str | None = None,
    count_ensemble: bool = False,
) -> DataFrame:
    """Combined prediction, uncertainty and 95 % interval of each row."""
    names = [*columns, ensemble] if ensemble and count_ensemble else list(columns)
    scored = with_uncertainty(df.withColumn("combined", combined_mean(names)), names, sigma)
    lower, upper = interval(F.col("combined"), F.col("uncertainty"))
    return scored.withColumns({"lower": lower, "upper": upper})


def actual_predicted(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Pairs of actual and predicted values with the ends of the line of perfect predictions."""
    ends = df.agg(
        F.struct(
            F.least(F.min(actual), F.min(predicted)).alias("lo"),
            F.greatest(F.max(actual), F.max(predicted)).alias("hi"),
        ).alias("ends")
    ).scalar()
    return df.select(
        F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), ends["lo"].alias("line_lo"), ends["hi"].alias("line_hi")
    )


def forecast_series(
    df: DataFrame,
    time: str,
    order: Sequence[str],
    actual: str,
    predicted: str = "combined",
    lower: str = "lower",
    upper: str = "upper",
) -> DataFrame:
    """Actual and predicted values with their interval in time order."""
    stamp = parse_timestamp(F.col(time)) if dict(df.dtypes)[time] == "string" else F.col(time)
    return df.orderBy(stamp, *order).select(
        stamp.alias("time"),
        F.col(actual).alias("actual"),
        F.col(predicted).alias("predicted"),
        F.col(lower).alias("lower"),
        F.col(upper).alias("upper"),
    )


def daily_series(
    df: DataFrame, time: str, actual: str, predicted: str = "combined", lower: str = "lower", upper: str = "upper"
) -> DataFrame:
    """The forecast series as daily means, small enough to draw."""
    return df.groupBy(F.to_date(time).alias("day")).agg(
        F.avg(actual).alias("actual"),
        F.avg(predicted).alias("predicted"),
        F.avg(lower).alias("lower"),
        F.avg(upper).alias("upper"),
        F.count("*").alias("n_rows"),
    )
