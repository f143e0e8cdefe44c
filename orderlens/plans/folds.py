"""Cross-validation of all linear members from the products of each fold: two passes over the rows.

The products of all columns (features, label, constant) are summed once per fold. The training part
of a fold is the total less the fold, so no member and no fold reads the rows again: every fit and
every score on held-out rows comes from matrices of the number of columns squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.columns import TARGET
from orderlens.plans.models import NET_ALPHA, NET_MIX, RIDGE_ALPHA, evidence_penalty

BLOCK_ROWS = 4096


def row_means(rows: DataFrame, label: str, features: str) -> np.ndarray:
    """Means of all features and of the label, summed on the executors: the origin of the products."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            total, seen = total + x.sum(0), seen + len(x)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array([seen] * len(total))], ["pos", "total", "n"])

    sums = rows.select(*_columns(label, features)).mapInArrow(add_up, "pos long, total double, n long")
    found = sums.groupBy("pos").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("pos").collect()  # one row a column
    return np.array([r["mean"] for r in found])


def _columns(label: str, features: str) -> list[Column]:
    return [vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Features and label of the rows of a batch."""
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return np.column_stack([flat.reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False)])


def fold_products(
    rows: DataFrame, label: str = TARGET, features: str = "features", fold: str = "fold"
) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Products of the centred columns and the constant, by fold, and the means they are centred by.

    Rows without a label or without a fold take no part. Centring keeps digits that sums of squares
    of large values would lose; it changes no fit. A task adds up its own rows; the sums of the tasks
    meet by fold and cell, so the driver gets (columns + 2) squared numbers a fold.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull())
    means = row_means(rows, label, features)
    if not len(means):
        return {}, means
    p = len(means) + 1
    upper = np.triu_indices(p)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            every, at = _matrix(batch), batch.column(2).to_numpy(zero_copy_only=False)
            for start in range(0, len(every), BLOCK_ROWS):
                part, folds = every[start : start + BLOCK_ROWS], at[start : start + BLOCK_ROWS]
                x = np.column_stack([part - means, np.ones(len(part))])
                for k in np.unique(folds):
                    own = x[folds == k]
                    sums[int(k)] = sums.get(int(k), 0.0) + own.T @ own
        for k, gram in sums.items():
            columns = [pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(gram[upper])]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "cell", "value"])

    partial = rows.select(*_columns(label, features), F.col(fold).cast("int").alias("fold"))
    cells = partial.mapInArrow(add_up, "fold int, cell int, value double")
    grams: dict[int, np.ndarray] = {}
    for row in cells.groupBy("fold", "cell").agg(F.sum("value").alias("value")).toLocalIterator():
        gram = grams.setdefault(row["fold"], np.zeros((p, p)))
        i, j = upper[0][row["cell"]], upper[1][row["cell"]]
        gram[i, j] = gram[j, i] = row["value"]
    return grams, means


def _centred(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, column means, products of the features, products with the label), about the own means."""
    n = gram[-1, -1]
    means = gram[-1, :-1] / n
    products = gram[:-1, :-1] - n * np.outer(means, means)
    return n, means, products[:-1, :-1], products[:-1, -1]


def ridge_weights(gram: np.ndarray, alpha: float = RIDGE_ALPHA) -> np.ndarray:
    """Weights with the least squared error plus ``alpha`` times their squares; the shortest where several do."""
    _, _, xx, xy = _centred(gram)
    return np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0]


def evidence_weights(gram: np.ndarray) -> np.ndarray:
    """Posterior mean weights of the Bayesian linear model."""
    return ridge_weights(gram, evidence_penalty(gram))


def net_weights(
    gram: np.ndarray, alpha: float = NET_ALPHA, mix: float = NET_MIX, tolerance: float = 1e-12, sweeps: int = 100_000
) -> np.ndarray:
    """Elastic net by coordinate descent on the products: half the mean squared error plus both penalties.

    Ends when the bound of the remaining gain is below ``tolerance`` of the label's variance.
    """
    n, means, xx, xy = _centred(gram)
    yy = gram[-2, -2] - n * means[-1] ** 2
    xx, xy, spread = xx / n, xy / n, max(yy / n, np.finfo(float).tiny)
    l1, l2 = alpha * mix, alpha * (1 - mix)
    weights, slopes = np.zeros(len(xy)), xy.copy()  # slopes: xy - xx @ weights
    for _ in range(sweeps):
        gain = 0.0
        for j, size in enumerate(np.diag(xx)):
            if size + l2 <= 0:
                continue
            pull = slopes[j] + size * weights[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (size + l2)
            step = new - weights[j]
            if step:
                weights[j] = new
                slopes -= xx[:, j] * step
                gain = max(gain, (size + l2) * step * step)
        if gain <= tolerance * tolerance * spread:
            break
    return weights


#: The linear members, each a function of the products of its training rows.
LINEAR_MEMBERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "elastic_net": net_weights,
    "ridge": ridge_weights,
    "bayesian_ridge": evidence_weights,
}


def held_out_r2(train: np.ndarray, test: np.ndarray, weights: np.ndarray) -> float | None:
    """R² on the test rows of the line fitted on the training rows, both known by their products only.

    1 for a constant label that is met, 0 for one that is not, none below two rows.
    """
    n = test[-1, -1]
    if n < 2:
        return None
    _, means, _, _ = _centred(train)
    intercept = means[-1] - means[:-1] @ weights
    residual = np.concatenate([-weights, [1.0, -intercept]])
    error = max(float(residual @ test @ residual), 0.0)
    spread = float(test[-2, -2] - test[-1, -2] ** 2 / n)
    if spread <= 0:
        return 1.0 if error == 0 else 0.0
    return 1 - error / spread


def linear_scores(
    rows: DataFrame,
    folds: int,
    names: Sequence[str] = tuple(LINEAR_MEMBERS),
    label: str = TARGET,
    features: str = "features",
    fold: str = "fold",
) -> DataFrame:
    """(model, fold, R²) of every linear member fitted on the other folds.

    All folds 0 to ``folds - 1`` are listed. A fold of fewer than two rows, or without training rows, has no score.
    """
    unknown = [n for n in names if n not in LINEAR_MEMBERS]
    if unknown:
        raise ValueError(f"no linear member: {unknown}")
    grams, _ = fold_products(rows, label, features, fold)
    total = sum(grams.values())
    scores = []
    for k in range(folds):
        test = grams.get(k)
        train = total - test if test is not None else total
        known = test is not None and train[-1, -1] >= 1
        for name in names:
            scores.append((name, k, held_out_r2(train, test, LINEAR_MEMBERS[name](train)) if known else None))
    return rows.sparkSession.createDataFrame(scores, "model string, fold int, r2 double")
