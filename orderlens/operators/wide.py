"""Statistics of all column pairs of a wide table, from matrix products of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import quoted

BLOCK_ROWS = 2048
# Share of a column's squares below which its variance counts as rounding: the column is constant.
ROUNDING = 1e-13

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pair_sums(df: DataFrame, columns: Sequence[str], centres: Sequence[float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every column pair i < j over the rows that have both values.

    Every block of rows is three matrices: values with gaps as zeros, their squares, and what is
    present. Their products give all six sums of all pairs; a task adds up its blocks, the tasks meet by pair.
    """
    p, centre = len(columns), np.asarray(centres, dtype=float)
    first, second = np.triu_indices(p, 1)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                raw = np.stack(batch["x"].iloc[start : start + BLOCK_ROWS].to_numpy()).astype(float) - centre
                there = ~np.isnan(raw)
                x, m = np.where(there, raw, 0.0), there.astype(float)
                sums, squares = x.T @ m, (x * x).T @ m
                part = np.stack([
                    (m.T @ m)[first, second], sums[first, second], sums[second, first],
                    squares[first, second], squares[second, first], (x.T @ x)[first, second],
                ])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": first, "j": second, **dict(zip(SUMS, total))})

    values = F.array(*[quoted(c).cast("double") for c in columns]).alias("x")
    partial = df.select(values).mapInPandas(add_up, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return partial.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def _variance(squares: str, total: str) -> Column:
    """n times the variance; zero where it is only rounding."""
    spread = F.col(squares) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
    return F.when(spread > ROUNDING * F.col(squares), spread).otherwise(0.0)


def block_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """(a, b, r) of all column pairs over the rows that have both values; NULL where one does not vary.

    One pass for the means, one for all pairs, whatever the width. None if some value is NaN or
    infinite: sums of blocks cannot keep those apart from gaps.
    """
    looked = [quoted(c).cast("double") for c in columns]
    about = df.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(looked)],
        *[F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias(f"o{i}") for i, x in enumerate(looked)],
    ).first()
    if any(about[f"o{i}"] for i in range(len(columns))):
        return None
    sums = pair_sums(df, columns, [about[f"m{i}"] or 0.0 for i in range(len(columns))])
    together = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    r = F.try_divide(together, F.sqrt(_variance("sxx", "sx") * _variance("syy", "sy")))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))
