"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The damping term of the ratio features and the standard 95 % and 80 %
# factors of the prediction intervals.
EPSILON = 1e-8
Z95 = 1.96
Z80 = 1.28

# Confidence thresholds of the batch report and of the record view.
REPORT_BANDS = (50.0, 100.0)
RECORD_BANDS = (30.0, 80.0)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows with both values; NULL where one of them does not vary.

    The built-in ``corr`` raises for a constant column in ANSI mode.
    """
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def row_text(row: Mapping[str, object]) -> str:
    """A row as lines of name and value."""
    width = max(map(len, row), default=0)
    show = lambda value: f"{value:,.6g}" if isinstance(value, float) else str(value)
    return "\n".join(f"{name:<{width}}  {show(value)}" for name, value in row.items())


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that aggregates skip it."""
    changes = {
        f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
        for f in df.schema
        if is_floating(f.dataType)
    }
    return df.withColumns(changes) if changes else df


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is NULL or NaN."""
    column = F.col(f"`{name}`")
    if is_floating(df.schema[name].dataType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def confidence_band(uncertainty: Column, bands: tuple[float, float] = RECORD_BANDS) -> Column:
    high, medium = bands
    return F.when(uncertainty < high, "High").when(uncertainty < medium, "Medium").otherwise("Low")


def row_features(columns: Sequence[str], names: Sequence[str]) -> Mapping[str, Column]:
    """Features of one row: squares, logarithms and the two interactions."""
    features: dict[str, Column] = {}
    for name in names:
        if name in columns:
            features[f"{name}_squared"] = F.col(name) * F.col(name)
            features[f"{name}_log"] = F.log1p(F.abs(F.col(name)))
    if {"sales_per_customer", "quantity"} <= set(columns):
        features["sales_quantity_interaction"] = F.col("sales_per_customer") * F.col("quantity")
    if {"days_real", "benefit"} <= set(columns):
        features["shipping_benefit_ratio"] = F.try_divide(F.col("days_real"), F.col("benefit") + EPSILON)
    return features


def hash_bucket(columns: Sequence[str], buckets: int, seed: int = 42) -> Column:
    """Stable bucket number of a row key: the same for any partitioning, engine or rerun."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets)).cast("int")


def hash_order(columns: Sequence[str], seed: int = 42) -> Column:
    """Pseudo-random but repeatable sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def one_row_to_long(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into one output row per entry of ``rows``."""
    structs = [F.struct(*[value.alias(name) for value, name in zip(row, names)]) for row in rows]
    return df.select(F.inline(F.array(*structs)))
