"""Features of the forecasting table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import EPSILON, quoted, row_features
from orderlens.operators.ordered import percentile_rank, trailing_mean


def interaction_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(dict(row_features(df.columns, columns)))


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_zscore") -> DataFrame:
    """Distance from the mean in sample deviations. The statistics are one row, read as a scalar subquery."""
    stats = df.agg(
        F.struct(
            *[F.avg(quoted(c)).alias(f"mean{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(quoted(c)).alias(f"std{i}") for i, c in enumerate(columns)],
        ).alias("stats")
    ).scalar()
    return df.withColumns(
        {f"{c}{suffix}": (quoted(c) - stats[f"mean{i}"]) / (stats[f"std{i}"] + EPSILON) for i, c in enumerate(columns)}
    )


def statistical_features(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Percentile rank, z-score and trailing mean of every column over the whole table."""
    present = [c for c in columns if c in df.columns]
    means = trailing_mean(df, present, order, partitions=partitions)
    return percentile_rank(zscores(means, present), present, partitions=partitions)
