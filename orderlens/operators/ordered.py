"""Row numbers, ranks and trailing means over a whole table, without a single-partition window.

Rows are range-partitioned by the full order key, so a single hot value of the leading
column is spread over many tasks by the columns after it. The range-partitioned rows are
written to the shared folder once: positions and partition counts then come from the very
same rows, also when an executor is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orderlens.functions.expressions import quoted
from orderlens.session import cut_lineage, shuffle_partitions, stored_rows

_POSITION_BITS = 33  # monotonically_increasing_id keeps the position in its lower 33 bits

# Distinct values of a column up to which its rank table (two numbers a row) is broadcast.
BROADCAST_VALUES = 300_000
# Values that hold at least this share of the rows, or a tenth of an even task, are hot: there can
# be at most 1/share or ten times the number of tasks of them.
HOT_SHARE = 1 / 1000
SALTS = 1024


def _in_order(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    parts = partitions or shuffle_partitions(df.sparkSession)
    keys = [quoted(c) for c in order]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return placed.withColumns(
        {
            "_part": F.spark_partition_id(),
            "_position": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    )


def _indexed(df: DataFrame, order: Sequence[str], name: str, partitions: int | None) -> tuple[DataFrame, int]:
    rows = cut_lineage(_in_order(df, order, partitions))
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    # One row per partition: the number of partitions bounds the broadcast.
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    joined = rows.join(F.broadcast(offsets), "_part")
    return joined.select(*[quoted(c) for c in df.columns], (F.col("_start") + F.col("_position")).alias(name)), total


def dense_index(
    df: DataFrame, order: Sequence[str], name: str = "idx", partitions: int | None = None
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order.

    ``order`` should tell all rows apart; rows with equal keys are numbered in any order.
    """
    return _indexed(df, order, name, partitions)[0]


def percentile_rank(
    df: DataFrame,
    columns: Sequence[str],
    suffix: str = "_percentile",
    broadcast_values: int = BROADCAST_VALUES,
    hot_share: float = HOT_SHARE,
    partitions: int | None = None,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Share of rows up to each value, ties at their average rank; NULL stays NULL.

    Rows are first reduced to counted distinct (column, value) pairs, all columns in one
    shuffle. Running counts over the range-partitioned pairs give the ranks, which are joined
    back by value. A rank table of checked size is broadcast; a larger one is joined by
    shuffle, except for the few values that hold many rows, which are broadcast. Columns
    named by ``spread_by`` (default: all) spread the rows of those hot values; a row key does
    best.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("_column"), F.col(f"`{c}`").cast("double").alias("_value"))
            for i, c in enumerate(columns)
        ]
    )
    counted = (
        df.select(F.inline(pairs))
        .where(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .groupBy("_column", "_value")
        .agg(F.count("*").alias("_rows"))
    )
    placed = counted.repartitionByRange(parts, "_column", "_value").sortWithinPartitions("_column", "_value")
    # the rows of a partition are in order: the rows before each value are added up where they are
    schema = "_column int, _value double, _rows long, _part int, _before long"
    values = cut_lineage(placed.withColumn("_part", F.spark_partition_id()).mapInArrow(_rows_before, schema))

    # At most one row per partition and column.
    sizes = (
        values.groupBy("_column", "_part").agg(F.sum("_rows").alias("rows"), F.count("*").alias("values")).collect()
    )
    total: dict[int, int] = defaultdict(int)
    distinct: dict[int, int] = defaultdict(int)
    starts = []
    for size in sorted(sizes, key=lambda r: (r["_column"], r["_part"])):
        starts.append((size["_column"], size["_part"], total[size["_column"]]))
        total[size["_column"]] += size["rows"]
        distinct[size["_column"]] += size["values"]
    offsets = df.sparkSession.createDataFrame(starts, "_column int, _part int, _start bigint")
    ranked = values.join(F.broadcast(offsets), ["_column", "_part"]).withColumn("_less", F.col("_start") + F.col("_before"))
    result = df
    for i, name in enumerate(columns):
        out = f"{name}{suffix}"
        if not total[i]:
            result = result.withColumn(out, F.lit(None).cast("double"))
            continue
        share = (F.col("_less") + (F.col("_rows") + 1) / 2) / F.lit(float(total[i]))
        table = ranked.where(F.col("_column") == i).select(F.col("_value"), F.col("_rows"), share.alias(out))
        if distinct[i] <= broadcast_values:
            small = F.broadcast(table.drop("_rows"))
            result = result.join(small, F.col(f"`{name}`") == F.col("_value"), "left").drop("_value")
        else:
            result = _join_skewed(result, table, name, out, max(2.0, total[i] * min(hot_share, 0.1 / parts)), spread_by or df.columns)
    return result


def _rows_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted values of a partition, in order, with the rows of their column before each."""
    seen: dict[int, int] = {}
    for batch in batches:
        column, rows = (batch.column(i).to_numpy() for i in (0, 2))
        upto = np.cumsum(rows)
        first = np.searchsorted(column, column)  # where the values of the column begin in this batch
        before = upto - rows - (upto - rows)[first] + np.array([seen.get(int(c), 0) for c in column[first]], np.int64)
        for c in np.unique(column):
            seen[int(c)] = seen.get(int(c), 0) + int(rows[column == c].sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], ["_column", "_value", "_rows", "_part", "_before"])


def _join_skewed(
    df: DataFrame, table: DataFrame, name: str, out: str, hot_rows: float, spread_by: Sequence[str]
) -> DataFrame:
    """Left join on a column of which some values may hold a large share of the rows.

    Rows of hot values are served by a broadcast of these few values. They take part in the
    shuffled join only with a NULL key and a salt from other columns, so they spread evenly.
    All other rows are salted by their value on both sides: a constant salt would be taken
    out of the join keys by the optimizer, and all NULL keys would meet in one task. A salt
    depends on nothing but the row, so a repeated task sends it to the same place.
    """
    number = F.col(f"`{name}`").cast("double") + 0.0  # makes -0.0 and 0.0 one value
    hot = table.where(F.col("_rows") >= hot_rows).select(F.col("_value").alias("_hot"), F.col(out).alias("_hot_out"))
    cold = table.where(F.col("_rows") < hot_rows).select(
        F.col("_value").alias("_cold"), _salt(F.col("_value") + 0.0).alias("_cold_salt"), F.col(out).alias("_cold_out")
    )
    open_row = F.col("_hot").isNull() & number.isNotNull()
    spread = _salt(*[F.col(f"`{c}`") for c in spread_by]) + SALTS
    keyed = df.join(F.broadcast(hot), number == F.col("_hot"), "left").withColumns(
        {"_key": F.when(open_row, number), "_salt": F.when(open_row, _salt(number)).otherwise(spread)}
    )
    joined = keyed.join(cold, (F.col("_key") == F.col("_cold")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_hot_out", "_cold_out").alias(out))


def _salt(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def trailing_window(rows: int, largest: int = 50) -> int:
    """Rows of the trailing mean: a twentieth of the table, at most ``largest`` and at least one."""
    return max(1, min(largest, rows // 20))


def trailing_mean(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    window: int | None = None,
    suffix: str = "_ma",
    block: int | None = None,
    index: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Mean of the last ``window`` rows up to each row, NULLs skipped, over the whole table's order.

    The numbered rows are cut into equal blocks. Each block also gets the last ``window - 1``
    rows of the block before it, so the window inside a block is exact and no block depends on
    how often a value occurs. With ``index`` the row number is kept under that name.
    """
    name = index or "_idx"
    rows, total = _indexed(df, order, name, partitions)
    return block_means(rows, columns, name, window or trailing_window(total), total, suffix, block).drop(
        *([] if index else [name])
    )


def stored_trailing_mean(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], suffix: str = "_ma", partitions: int | None = None, largest: int = 50
) -> tuple[DataFrame, int]:
    """The rows with their trailing means, stored in order, and the window that follows from their number.

    The rows move once: each range of the order is one sorted task, which averages over its rows as they pass. The
    first rows of a range lack those of the range before; their means are made of the ends of the ranges,
    fewer than ``2 * largest`` rows each.
    """
    names = [f"{c}{suffix}" for c in columns]
    placed = _in_order(df, order, partitions)
    made = StructType([*placed.schema, *[StructField(n, DoubleType()) for n in names]])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros((len(columns), 0)), np.zeros((len(columns), 0), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, known = (np.concatenate([a, b], axis=1) for a, b in zip(before, _numbers(batch, columns)))
            means, any_ = _window_means(values, known, largest, values.shape[1] - batch.num_rows)
            before = values[:, -(largest - 1) :], known[:, -(largest - 1) :]
            out = [pa.array(m, pa.float64(), mask=~a) for m, a in zip(means, any_)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

    rows = stored_rows(placed.mapInArrow(averaged, made))
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    total = sum(counts.values())
    window = trailing_window(total, largest)
    keep = [quoted(c) for c in df.columns]
    if window < largest:  # a small table
        starts = df.sparkSession.createDataFrame([(p, sum(n for q, n in counts.items() if q < p)) for p in counts], "_part int, _start bigint")
        numbered = rows.join(F.broadcast(starts), "_part").select(*keep, (F.col("_start") + F.col("_position")).alias("_idx"))
        return stored_rows(block_means(numbered, columns, "_idx", window, total, suffix).drop("_idx")), window

    ends = df.sparkSession.createDataFrame([(p, n) for p, n in counts.items()], "_end_part int, _rows bigint")
    near = rows.join(F.broadcast(ends), F.col("_part") == F.col("_end_part"))
    near = near.where((F.col("_position") < window - 1) | (F.col("_position") > F.col("_rows") - window))
    near = near.select("_part", "_position", *[F.col(f"`{c}`").cast("double") for c in columns]).orderBy("_part", "_position").collect()
    by_part: dict[int, dict[int, tuple]] = defaultdict(dict)
    for row in near:
        by_part[row[0]][row[1]] = row[2:]
    fixes, last = [], []
    for part in sorted(by_part):
        head = [by_part[part][i] for i in range(min(window - 1, counts[part]))]
        some = last + head
        values = np.array([[np.nan if v is None else v for v in row] for row in some], float).reshape(len(some), len(columns)).T
        known = np.array([[v is not None for v in row] for row in some], bool).reshape(len(some), len(columns)).T
        means, any_ = _window_means(np.where(known, values, 0.0), known, window, len(last))
        fixes += [(part, i, *[float(m) if a else None for m, a in zip(means[:, i], any_[:, i])]) for i in range(len(head))]
        last = (last + [by_part[part][i] for i in sorted(by_part[part])[-(window - 1) :]])[-(window - 1) :]
    schema = "_fix_part int, _fix_position long, " + ", ".join(f"_fix{i} double" for i in range(len(columns)))
    joined = rows.join(
        F.broadcast(df.sparkSession.createDataFrame(fixes, schema)),
        (F.col("_part") == F.col("_fix_part")) & (F.col("_position") == F.col("_fix_position")),
        "left",
    )
    fixed = [F.when(F.col("_fix_part").isNotNull(), F.col(f"_fix{i}")).otherwise(quoted(n)).alias(n) for i, n in enumerate(names)]
    return joined.select(*keep, *fixed), window


def _numbers(batch: pa.RecordBatch, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a batch as (columns, rows) of numbers, zero for NULL, and which of them are not NULL."""
    found = [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()) for c in columns]
    known = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in found], bool).reshape(len(columns), batch.num_rows)
    return np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in found], float).reshape(known.shape), known


def _window_means(values: np.ndarray, known: np.ndarray, window: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known ones of the last ``window`` values up to each from ``first`` on, and whether there are any."""
    lead = max(0, window - 1 - first)
    values, known = (np.pad(x[:, max(0, first - window + 1) :], ((0, 0), (lead, 0))) for x in (values, known))
    sums = np.lib.stride_tricks.sliding_window_view(values, window, axis=1).sum(axis=2)
    counts = np.lib.stride_tricks.sliding_window_view(known, window, axis=1).sum(axis=2)
    with np.errstate(invalid="ignore"):
        return sums / np.maximum(counts, 1), counts > 0


def block_means(
    rows: DataFrame,
    columns: Sequence[str],
    index: str,
    window: int,
    total: int,
    suffix: str = "_ma",
    block: int | None = None,
) -> DataFrame:
    """The trailing means of rows that already carry a dense index."""
    if block is None:
        parts = shuffle_partitions(rows.sparkSession)
        block = min(1_000_000, max(10 * window, -(-total // (4 * parts))))
    if block < window:
        raise ValueError("a block must hold at least one window")
    own = F.expr(f"`{index}` div {block}")
    in_tail = F.pmod(F.col(index), F.lit(block)) > block - window
    copies: Column = F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own)))
    spread = rows.select("*", copies.alias("_block"))
    over = W.partitionBy("_block").orderBy(index).rowsBetween(-(window - 1), 0)
    means = spread.select("*", *[F.avg(f"`{c}`").over(over).alias(f"{c}{suffix}") for c in columns])
    return means.where(F.col("_block") == own).drop("_block")
