"""Exact quantiles without gathering a column in one task.

The built-in exact ``percentile`` keeps every distinct value of the column in one
aggregation buffer. Here each pass over the data places marks around the wanted order
statistic with mergeable sketches of bounded size, and counts the rows below and up to each
mark. The counts are exact, so they tell for certain between which marks the order statistic
lies, however good the sketch was. Only when few rows are left between two marks are their
distinct values counted and brought to the driver. A pass leaves about ``2 * slack`` of the
rows, and a value that very many rows share is found by its count alone.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Size of the sketches, and the distance of a mark from its rank as a share of the rows.
# A sketch of this size misses a rank by some 0.06 % of the rows.
SKETCH_SIZE = 8000
SLACK = 0.001
# Sketches of the map tasks are merged in this many groups before the last merge.
MERGE_GROUPS = 256


@dataclass
class _Rank:
    """The row of a given rank (from 0) of a column, known to lie strictly between lo and hi."""

    column: str
    rank: int
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    @property
    def range_key(self) -> tuple[str, float | None, float | None]:
        return self.column, self.lo, self.hi

    def place(self, marks: Iterable[tuple[float, int, int]]) -> None:
        """Narrow the range with marks (value, rows below it, rows up to it) in ascending order."""
        end = self.below + self.inside
        for mark, less, up_to in marks:
            if self.rank < less:
                self.hi, end = mark, less
                break
            if self.rank < up_to:
                self.value = mark
                return
            self.lo, self.below = mark, up_to
        self.inside = end - self.below


def _number(column: str) -> str:
    """A column as a double, in SQL: thousands of marks as column objects would take longer to build than to count."""
    return f"CAST(`{column.replace('`', '``')}` AS DOUBLE)"


def _literal(value: float) -> str:
    return f"{value!r}D" if math.isfinite(value) else f"DOUBLE('{'-' if value < 0 else ''}Infinity')"


def _between(value: str, lo: float | None, hi: float | None) -> str:
    """The condition that a value lies strictly between two marks."""
    sides = [f"{value} > {_literal(lo)}"] if lo is not None else []
    sides += [f"{value} < {_literal(hi)}"] if hi is not None else []
    return " AND ".join(sides or ["true"])


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    size: int = SKETCH_SIZE,
    slack: float = SLACK,
    small: int = 20_000,
    keep: bool = True,
) -> dict[str, list[float | None]]:
    """Quantiles of every column with linear interpolation between neighbouring values.

    NULL and NaN are skipped; a column without values gives None. The columns are kept between the
    passes, in memory or on local disk, so that the joins behind them run once; ``keep=False``
    reads them anew in every pass, which is cheaper for a plain scan.
    """
    if not columns:
        return {}
    rows = df.selectExpr(*[f"CASE WHEN NOT isnan({_number(c)}) THEN {_number(c)} END AS `{c.replace('`', '``')}`" for c in columns])
    if not keep:
        return _exact_quantiles(rows, columns, probabilities, size, slack, small)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _exact_quantiles(rows, columns, probabilities, size, slack, small)
    finally:
        rows.unpersist()


def _exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], size: int, slack: float, small: int
) -> dict[str, list[float | None]]:
    grid = _grid(probabilities, slack)
    sketched = _sketch(df, [(_number(c), grid) for c in columns], size)
    filled = {c: rows for c, (rows, _) in zip(columns, sketched)}
    marks = {c: found for c, (_, found) in zip(columns, sketched)}

    ranks: dict[tuple[str, int], _Rank] = {}
    for name, rows in filled.items():
        for p in probabilities if rows else ():
            for rank in {math.floor((rows - 1) * p), math.ceil((rows - 1) * p)}:
                ranks[name, rank] = _Rank(name, rank, rows)
    _place_all(df, list(ranks.values()), marks)
    while wide := [r for r in ranks.values() if r.value is None and r.inside > small]:
        _place_all(df, wide, _range_marks(df, wide, slack, size))
    _read_values(df, [r for r in ranks.values() if r.value is None])

    result: dict[str, list[float | None]] = {}
    for name, rows in filled.items():
        result[name] = []
        for p in probabilities:
            if not rows:
                result[name].append(None)
                continue
            position = (rows - 1) * p
            low = ranks[name, math.floor(position)].value
            high = ranks[name, math.ceil(position)].value
            result[name].append(low + (high - low) * (position - math.floor(position)))
    return result


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], size: int = SKETCH_SIZE
) -> dict[str, list[float | None]]:
    """Quantiles of every column in one pass, near the wanted rank by the error of the sketch."""
    if not columns:
        return {}
    sketched = _sketch(df, [(_number(c), list(probabilities)) for c in columns], size)
    return {c: list(found) or [None] * len(probabilities) for c, (_, found) in zip(columns, sketched)}


@dataclass
class _Summary:
    """Up to ``size`` values of a column in order, the rows that each stands for, and the least and largest of all."""

    values: np.ndarray
    rows: np.ndarray
    ends: tuple[float, float] | None

    @classmethod
    def of(cls, parts: Sequence[_Summary], size: int) -> _Summary:
        """One summary of several: values at evenly spaced ranks, which depend on the order of the values alone."""
        ends = [p.ends for p in parts if p.ends]
        if not ends:
            return cls(np.zeros(0), np.zeros(0), None)
        values, rows = np.concatenate([p.values for p in parts]), np.concatenate([p.rows for p in parts])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(rows[order])
        if len(values) > size:
            step = upto[-1] / size
            values, rows = values[np.searchsorted(upto, (np.arange(size) + 0.5) * step)], np.full(size, step)
        else:
            rows = rows[order]
        return cls(values, rows, (min(a for a, _ in ends), max(b for _, b in ends)))

    def quantiles(self, shares: Sequence[float]) -> list[float]:
        if self.ends is None:
            return []
        upto = np.cumsum(self.rows)
        at = np.searchsorted(upto, np.array(shares) * upto[-1] * (1 - 1e-12))
        inner = self.values[np.minimum(at, len(upto) - 1)]
        return [self.ends[0] if share <= 0 else self.ends[1] if share >= 1 else float(v) for share, v in zip(shares, inner)]


def ranked_marks(df: DataFrame, columns: int, shares: Sequence[float], size: int, rows: int = 1 << 16, arity: int = 16) -> list[list[float]]:
    """Quantiles of each entry of the only column, an array of as many doubles, near the wanted rank; NaN is skipped.

    Rows are summed up in numpy by ``size`` values at even ranks, ``rows`` of them at first and then ``arity`` summaries
    at a time, so that a rank is off by half a step for each time its row took part. The marks follow from the order
    of the rows' values alone: columns with the same order get marks in the same rows.
    """
    if not columns:
        return []

    def raw(x: np.ndarray) -> list[_Summary]:
        out = []
        for values in np.sort(x.T, axis=1):  # NaN comes last
            values = values[: len(values) - np.count_nonzero(np.isnan(values))]
            step, ends = max(1.0, len(values) / size), (values[0], values[-1]) if len(values) else None
            kept = values if step == 1 else values[((np.arange(size) + 0.5) * step).astype(int)]
            out.append(_Summary(kept, np.full(len(kept), step), ends))
        return out

    def merged(parts: Sequence[list[_Summary]]) -> list[_Summary]:
        return [_Summary.of(own, size) for own in zip(*parts)]

    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, levels = [], defaultdict(list)

        def add(made: list[_Summary], level: int = 0) -> None:
            levels[level].append(made)
            if len(levels[level]) == arity:
                add(merged(levels.pop(level)), level + 1)

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, columns))
            if sum(map(len, held)) >= rows:
                add(raw(np.concatenate(held)))
                held = []
        if held:
            add(raw(np.concatenate(held)))
        if all_ := [made for level in levels.values() for made in level]:
            yield packed(merged(all_))

    def packed(made: list[_Summary]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps([(s.values, s.rows, s.ends) for s in made])], pa.binary())], ["made"])

    def unpacked(made: bytes) -> list[_Summary]:
        return [_Summary(*s) for s in pickle.loads(made)]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [unpacked(made.as_py()) for batch in batches for made in batch.column(0)]:
            yield packed(merged(parts))

    first = df.mapInArrow(summed_up, "made binary")
    found = [unpacked(bytes(r["made"])) for r in first.repartition(arity).mapInArrow(met, "made binary").collect()]
    return [s.quantiles(shares) for s in merged(found)] if found else [[] for _ in range(columns)]


def _sketch(df: DataFrame, wanted: Sequence[tuple[str, Sequence[float]]], size: int) -> list[tuple[int, list[float]]]:
    """Number of values and sketched quantiles of every expression.

    Merged in two steps, so that no task receives the sketches of all map tasks.
    """
    counts = [F.expr(f"count({value})").alias(f"n{i}") for i, (value, _) in enumerate(wanted)]
    sketches = [F.expr(f"kll_sketch_agg_double({value}, {size})").alias(f"s{i}") for i, (value, _) in enumerate(wanted)]
    parts = df.groupBy(F.expr(f"pmod(spark_partition_id(), {MERGE_GROUPS})").alias("group")).agg(*counts, *sketches)
    merged = parts.selectExpr(
        *[f"sum(n{i}) AS n{i}" for i in range(len(wanted))], *[f"kll_merge_agg_double(s{i}) AS s{i}" for i in range(len(wanted))]
    )
    shares = [f"array({', '.join(_literal(float(p)) for p in grid)})" for _, grid in wanted]
    quantiles = [f"CASE WHEN n{i} > 0 THEN kll_sketch_get_quantile_double(s{i}, {grid}) END AS q{i}" for i, grid in enumerate(shares)]
    row = merged.selectExpr(*[f"n{i}" for i in range(len(wanted))], *quantiles).first()
    return [(row[f"n{i}"] or 0, row[f"q{i}"] or []) for i in range(len(wanted))]


def _grid(shares: Iterable[float], slack: float) -> list[float]:
    return sorted({min(1.0, max(0.0, share + side * slack)) for share in shares for side in (-1, 1)})


def _range_marks(df: DataFrame, ranks: Sequence[_Rank], slack: float, size: int) -> dict[str, list[float]]:
    """Marks around every rank, from a sketch of the rows of its present range only."""
    by_range: dict[tuple, list[float]] = defaultdict(list)
    for r in ranks:
        by_range[r.range_key].append((r.rank - r.below + 0.5) / r.inside)
    wanted = [
        (f"CASE WHEN {_between(_number(column), lo, hi)} THEN {_number(column)} END", _grid(shares, slack))
        for (column, lo, hi), shares in by_range.items()
    ]
    marks: dict[str, list[float]] = defaultdict(list)
    for key, (_, found) in zip(by_range, _sketch(df, wanted, size)):
        marks[key[0]] += found
    return marks


def _place_all(df: DataFrame, ranks: Sequence[_Rank], marks: dict[str, Sequence[float]]) -> None:
    """Count the rows around all marks in one pass and narrow every range with them."""
    wanted = [(c, m) for c in {r.column for r in ranks} for m in sorted(set(marks[c]))]
    if not wanted:
        return
    by_name = {c: np.array([m for name, m in wanted if name == c]) for c in dict.fromkeys(c for c, _ in wanted)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less, up_to = ([np.zeros(len(m), np.int64) for m in by_name.values()] for _ in range(2))
        for batch in batches:
            for i, own in enumerate(by_name.values()):
                values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                less[i] += [np.count_nonzero(values < m) for m in own]
                up_to[i] += [np.count_nonzero(values <= m) for m in own]
        columns = [pa.array(np.arange(len(wanted))), pa.array(np.concatenate(less)), pa.array(np.concatenate(up_to))]
        yield pa.RecordBatch.from_arrays(columns, ["mark", "less", "up_to"])

    # in numpy: hundreds of counts are too large an aggregate for Spark to compile
    counts = df.selectExpr(*[f"{_number(c)} AS c{i}" for i, c in enumerate(by_name)]).mapInArrow(count, "mark long, less long, up_to long")
    found = {r["mark"]: r for r in counts.groupBy("mark").agg(F.sum("less").alias("less"), F.sum("up_to").alias("up_to")).collect()}
    counted: dict[str, list[tuple[float, int, int]]] = defaultdict(list)
    for i, (c, m) in enumerate((c, float(m)) for c, own in by_name.items() for m in own):
        counted[c].append((m, found[i]["less"], found[i]["up_to"]) if i in found else (m, 0, 0))
    for r in ranks:
        r.place(
            mark
            for mark in counted[r.column]
            if (r.lo is None or mark[0] > r.lo) and (r.hi is None or mark[0] < r.hi)
        )


def _read_values(df: DataFrame, ranks: Sequence[_Rank]) -> None:
    """Look the remaining ranks up among the distinct values of their ranges, which hold few rows."""
    if not ranks:
        return
    columns = sorted({r.column for r in ranks})
    pairs = ", ".join(f"named_struct('column', {i}, 'value', {_number(c)})" for i, c in enumerate(columns))
    ranges = {r.range_key for r in ranks}
    inside = " OR ".join(f"column = {columns.index(c)} AND {_between('value', lo, hi)}" for c, lo, hi in ranges)
    rows = df.selectExpr(f"inline(array({pairs}))").where(f"value IS NOT NULL AND ({inside})")
    counted = rows.groupBy("column", "value").count().collect()
    by_column: dict[str, list[tuple[float, int]]] = defaultdict(list)
    for row in sorted(counted):
        by_column[columns[row["column"]]].append((row["value"], row["count"]))
    for r in ranks:
        seen = r.below
        for number, count in by_column[r.column]:
            if (r.lo is not None and number <= r.lo) or (r.hi is not None and number >= r.hi):
                continue
            seen += count
            if r.rank < seen:
                r.value = number
                break
