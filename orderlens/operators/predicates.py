"""Filters and comparison conditions as lazy column predicates."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.columns import FILTER_COLUMNS
from orderlens.functions.expressions import is_numeric, one_row_to_long, quoted, string_columns
from orderlens.operators.quantiles import exact_quantiles

COMPARISONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def filter_predicate(df: DataFrame, filters: Mapping[str, Any]) -> Column:
    """A pair means a closed range, a list means membership; an empty list does not filter.

    Columns that the table lacks are passed over.
    """
    parts = []
    for name, wanted in filters.items():
        if name not in df.columns:
            continue
        if isinstance(wanted, tuple):
            low, high = wanted
            parts.append(quoted(name).between(low, high))
        elif wanted:
            parts.append(quoted(name).isin(list(wanted)))
    return all_of(parts)


def apply_filters(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    return df.where(filter_predicate(df, filters))


def condition_predicate(df: DataFrame, column: str, operator: str, value: Any, regex: bool = False) -> Column:
    """One comparison.

    NULL never equals or orders against a value, but counts as different from every value.
    A number is never equal to a text. ``contains`` ignores case; with ``regex`` the value is
    a regular expression.
    """
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")
    field = quoted(column)
    numeric = is_numeric(df.schema[column].dataType)
    if operator in ("==", "!="):
        if numeric == isinstance(value, str):
            return F.lit(operator == "!=")
        return field == F.lit(value) if operator == "==" else ~field.eqNullSafe(F.lit(value))
    if operator in COMPARISONS:
        if not numeric:
            raise TypeError(f"{operator} needs a numeric column, {column} is not")
        return COMPARISONS[operator](field, F.lit(float(value)))
    if operator == "contains":
        text = field.cast("string")
        found = text.rlike(f"(?i){value}") if regex else F.lower(text).contains(str(value).lower())
        return F.coalesce(found, F.lit(False))
    raise ValueError(f"unknown operator: {operator}")


def conditions_predicate(
    df: DataFrame, conditions: Sequence[Mapping[str, Any]], lenient: bool = False, regex: bool = False
) -> Column:
    """All conditions at once. ``lenient`` skips, with a warning, a condition that cannot apply."""
    parts = []
    for entry in conditions:
        try:
            parts.append(condition_predicate(df, entry["column"], entry["operator"], entry["value"], regex))
        except (ValueError, TypeError) as problem:
            if not lenient:
                raise
            warnings.warn(f"condition skipped: {problem}", stacklevel=2)
    return all_of(parts)


def apply_conditions(
    df: DataFrame, conditions: Sequence[Mapping[str, Any]], lenient: bool = False, regex: bool = False
) -> DataFrame:
    return df.where(conditions_predicate(df, conditions, lenient, regex))


def filter_ratio(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows before, rows kept and percent kept, in one pass."""
    return df.agg(F.count("*").alias("total"), F.count_if(predicate).alias("kept")).select(
        "total", "kept", F.coalesce(F.try_divide(F.col("kept") * 100.0, F.col("total")), F.lit(0.0)).alias("ratio")
    )


def range_bounds(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, for columns that have more than one value."""
    bounds = df.agg(
        *[F.min(quoted(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(names)],
        *[F.max(quoted(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(names)],
    )
    rows = [(F.lit(c), F.col(f"lo{i}"), F.col(f"hi{i}")) for i, c in enumerate(names)]
    return one_row_to_long(bounds, rows, ["column", "lo", "hi"]).where("lo < hi")


def distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct non-null (column, value) pairs; copies are dropped before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in names])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def filterable_categoricals(
    df: DataFrame, names: Sequence[str] = tuple(FILTER_COLUMNS), max_values: int = 20
) -> DataFrame:
    """Text columns with few values, one row per column with its sorted values.

    Values are gathered only for columns already known to have at most ``max_values`` of
    them, and the table of those columns has at most one row per name, so it may be broadcast.
    """
    texts = [c for c in names if c in string_columns(df)]
    pairs = distinct_values(df, texts)
    small = pairs.groupBy("column").agg(F.count("*").alias("n_values")).where(F.col("n_values") <= max_values)
    return (
        pairs.join(F.broadcast(small), "column")
        .groupBy("column")
        .agg(F.max("n_values").alias("n_values"), F.array_sort(F.collect_list("value")).alias("options"))
    )


def sorted_distinct(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    values = df.select(quoted(name)).where(quoted(name).isNotNull()).distinct().orderBy(quoted(name))
    return values.limit(limit) if limit is not None else values


def pick_list(df: DataFrame, name: str, limit: int = 50) -> list[Any] | None:
    """Sorted values of a column, or None if there are more than ``limit`` (then ask for free text)."""
    rows = sorted_distinct(df, name, limit + 1).collect()
    return [r[0] for r in rows] if len(rows) <= limit else None


def picker_defaults(df: DataFrame, name: str) -> DataFrame:
    """Bounds and median of a numeric column: the range and start value of a number picker."""
    median = exact_quantiles(df, [name], [0.5])[name][0]
    return df.agg(
        F.min(quoted(name)).cast("double").alias("lo"),
        F.max(quoted(name)).cast("double").alias("hi"),
        F.lit(median).cast("double").alias("median"),
    )
