"""Choosing, filling and casting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.columns import TARGET
from orderlens.functions.expressions import numeric_columns
from orderlens.operators.profiling import non_empty_columns


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def without_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.drop(target)


def with_target_only(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows whose target is known."""
    return df.na.drop(subset=[target])


def numeric_only(df: DataFrame) -> DataFrame:
    """The numeric columns with NULL and NaN as zero."""
    return df.select(*numeric_columns(df)).na.fill(0)


def reindex(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the given columns; one that the table lacks is zero."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


def display_texts(df: DataFrame) -> DataFrame:
    """Texts, whole numbers and nested values as text, for display."""
    plain = (T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name) for f in df.schema]
    )


def offered_columns(df: DataFrame) -> DataFrame:
    """The table without the columns that hold no value at all."""
    return df.select(*non_empty_columns(df))
