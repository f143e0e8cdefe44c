"""Table profiles and group statistics, each in as few passes as its result allows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.columns import TARGET
from orderlens.functions.expressions import is_numeric, missing, numeric_columns, one_row_to_long, pearson, quoted, string_columns
from orderlens.operators.predicates import distinct_values
from orderlens.operators.quantiles import exact_quantiles
from orderlens.operators.wide import block_correlations


# Column pairs whose correlations one aggregate computes.
PAIRS_A_PASS = 1225
# Passes up to which a correlation matrix is put together from such aggregates.
MOST_PASSES = 4


def table_shape(df: DataFrame, n_columns: int | None = None) -> DataFrame:
    """Rows and columns; with ``n_columns`` any one column of a wider table will do to count its rows."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(n_columns or len(df.columns)).alias("n_columns"))


def target_stats(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(
        F.sum(target).alias("sum_sales"),
        F.avg(target).alias("mean_sales"),
        F.max(target).alias("max_sales"),
        F.min(target).alias("min_sales"),
    )


def small_text_columns(df: DataFrame, max_values: int = 10) -> list[str]:
    """Text columns with at most ``max_values`` distinct values, in table order."""
    texts = string_columns(df)
    if not texts:
        return []
    few = distinct_values(df, texts).groupBy("column").count().where(F.col("count") <= max_values).collect()
    named = {row["column"] for row in few}
    return [c for c in texts if c in named]


def group_totals(df: DataFrame, by: str, target: str = TARGET) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(target).alias("sum_sales"))


def group_stats(df: DataFrame, by: str, target: str = TARGET, limit: int | None = 10) -> DataFrame:
    """Count, sum and mean per group, the first groups in key order."""
    groups = (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count(target).alias("n_sales"),
            F.sum(target).alias("sum_sales"),
            F.avg(target).alias("mean_sales"),
        )
        .orderBy(by)
    )
    return groups.limit(limit) if limit is not None else groups


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Most frequent values; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The mode, the smallest one of a tie. Counts per value are aggregated by key, never in one buffer."""
    return top_values(df, column, 1).select(F.col("value").alias("mode"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    counted = df.agg(*[count(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = [(F.lit(c), F.col(f"d{i}")) for i, c in enumerate(columns)]
    return one_row_to_long(counted, rows, ["column", "n_distinct"])


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column.

    The columns are kept while the passes of the quartiles and the aggregate read them; the
    result is one line per column.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    kept = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        quartiles = exact_quantiles(kept, names, [0.25, 0.5, 0.75], keep=False)
        parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        row = kept.agg(
            *[f(F.col(f"`{c}`")).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in parts.items()]
        ).first()
    finally:
        kept.unpersist()
    lines = [
        (c, *[row[f"{k}_{i}"] for k in ("n", "mean", "std", "min")], *quartiles[c], row[f"max_{i}"])
        for i, c in enumerate(names)
    ]
    kinds = ", ".join(f"{k} double" for k in ("mean", "std", "min", "q25", "q50", "q75", "max"))
    return df.sparkSession.createDataFrame(lines, f"column string, n bigint, {kinds}")


def missing_report(df: DataFrame) -> DataFrame:
    """Missing values per column, most first; columns without any are left out."""
    counted = df.agg(
        F.count("*").alias("total"), *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        (F.lit(c), F.col(f"m{i}"), F.col(f"m{i}") * 100.0 / F.col("total")) for i, c in enumerate(df.columns)
    ]
    counts = counted.where("total > 0")
    return (
        one_row_to_long(counts, rows, ["column", "n_missing", "pct_missing"])
        .where("n_missing > 0")
        .orderBy(F.desc("n_missing"), "column")
    )


def non_empty_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value."""
    row = df.agg(*[F.count_if(~missing(df, c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, kind, filled and distinct values of every column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    texts = string_columns(df)
    counted = df.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[count(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        (
            F.lit(f.name),
            F.lit(f.dataType.simpleString()),
            F.lit("numeric" if is_numeric(f.dataType) else "text" if f.name in texts else "other"),
            F.col(f"n{i}"),
            F.col(f"d{i}"),
        )
        for i, f in enumerate(df.schema)
    ]
    return one_row_to_long(counted, rows, ["column", "data_type", "kind", "n_filled", "n_distinct"])


def type_summary(profile: DataFrame) -> DataFrame:
    """Columns per data type of a column profile."""
    return profile.groupBy("data_type").agg(F.count("*").alias("n_columns"))


def kind_counts(profile: DataFrame) -> DataFrame:
    """Numbers of numeric and of text columns of a column profile."""
    return profile.agg(
        F.count_if(F.col("kind") == "numeric").alias("n_numeric"), F.count_if(F.col("kind") == "text").alias("n_text")
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows that have both values; NULL for a constant column.

    Up to ``PAIRS_A_PASS`` pairs (50 columns) share one pass over the table; more of them take
    further passes, so that no aggregate grows with the square of the table's width. Beyond
    ``MOST_PASSES`` of these all pairs come from products of blocks of rows, in one pass (``wide``).
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    pairs = list(combinations(names, 2))
    if len(pairs) > MOST_PASSES * PAIRS_A_PASS:
        found = block_correlations(df, names)
        if found is not None:
            return found
    result = df.sparkSession.createDataFrame([], "a string, b string, r double")
    for first in range(0, len(pairs), PAIRS_A_PASS):
        part = pairs[first : first + PAIRS_A_PASS]
        row = df.agg(*[pearson(quoted(a), quoted(b)).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        rows = [(F.lit(a), F.lit(b), F.col(f"r{i}")) for i, (a, b) in enumerate(part)]
        result = result.union(one_row_to_long(row, rows, ["a", "b", "r"])) if first else one_row_to_long(row, rows, ["a", "b", "r"])
    return result


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from minimum to maximum; the maximum belongs to the last bin."""
    value = F.col(column).cast("double")
    limits = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("limits")).scalar()
    lo, hi = limits["lo"], limits["hi"]
    width = (hi - lo) / F.lit(float(bins))
    place = F.when(hi > lo, F.least(F.floor(F.try_divide(value - lo, width)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = (
        df.where(value.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )
    return counts.select("bin", (lo + F.col("bin") * width).alias("bin_lo"), (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "n")


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """Exact quartiles, 1.5 IQR fences, whisker ends and the number of outliers."""
    q25, q50, q75 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    if q25 is None:
        raise ValueError(f"{column} has no values")
    low, high = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
    value = F.col(column).cast("double")
    inside = value.between(low, high)
    return df.agg(
        F.lit(q25).alias("q25"),
        F.lit(q50).alias("q50"),
        F.lit(q75).alias("q75"),
        F.lit(low).alias("lower_fence"),
        F.lit(high).alias("upper_fence"),
        F.min(F.when(inside, value)).alias("lower_whisker"),
        F.max(F.when(inside, value)).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    )


def model_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of every prediction column."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns])
    return one_row_to_long(row, [(F.lit(c), F.col(c)) for c in columns], ["model", "mean_prediction"])


def prediction_overview(
    df: DataFrame, predicted: str, actual: str | None = None, uncertainty: str | None = None
) -> DataFrame:
    """Sum and mean of the predictions with their error, or their spread where the truth is unknown."""
    p = F.col(predicted)
    parts: list[Column] = [F.sum(p).alias("total_predicted"), F.avg(p).alias("mean_predicted")]
    if actual is not None:
        parts.append(F.avg(F.abs(F.col(actual) - p)).alias("mae"))
    else:
        parts.append(F.stddev_pop(p).alias("std_predicted"))
    if uncertainty is not None:
        parts.append(F.avg(uncertainty).alias("mean_uncertainty"))
    else:
        parts.append((F.max(p) - F.min(p)).alias("prediction_range"))
    return df.agg(*parts)


def business_context(df: DataFrame, target: str = TARGET, market: str = "market") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.avg(target).alias("mean_sales"),
        F.stddev_samp(target).alias("std_sales"),
        F.count_distinct(market).alias("n_markets"),
    )


def dataset_summary(df: DataFrame, target: str = TARGET, n_columns: int | None = None) -> DataFrame:
    """Rows, columns and the target's statistics; ``n_columns`` as in ``table_shape``."""
    median = exact_quantiles(df, [target], [0.5])[target][0]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(n_columns or len(df.columns)).alias("n_columns"),
        F.sum(target).alias("sum_sales"),
        F.avg(target).alias("mean_sales"),
        F.lit(median).cast("double").alias("median_sales"),
        F.min(target).alias("min_sales"),
        F.max(target).alias("max_sales"),
    )
