import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from orderlens.plans import folds, models


def table(n=900, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1.0, 5.0, 0.1, 2.0] + shift
    y = x @ [2.0, -1.0, 0.0, 0.02] + rng.normal(size=n) + 7
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, k):
    rows = [(Vectors.dense(a), None if np.isnan(b) else float(b), int(f)) for a, b, f in zip(x, y, k)]
    return spark.createDataFrame(rows, ["features", "sales", "fold"])


def direct(name, x, y):
    """Weights from the rows themselves."""
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    if name == "elastic_net":  # proximal gradient steps on the penalised error
        size = np.linalg.eigvalsh(xc.T @ xc / n).max() + 0.05
        w = np.zeros(x.shape[1])
        for _ in range(200_000):
            step = w - (xc.T @ (xc @ w - yc) / n + 0.05 * w) / size
            new = np.sign(step) * np.maximum(np.abs(step) - 0.05 / size, 0)
            if np.abs(new - w).max() < 1e-13:
                break
            w = new
        return w
    gram = np.column_stack([x, y, np.ones(n)])
    alpha = 1.0 if name == "ridge" else models.evidence_penalty(gram.T @ gram)
    return np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)


def expected(name, x, y, k, fold):
    out, own = k != fold, k == fold
    w = direct(name, x[out], y[out])
    p = y[out].mean() + (x[own] - x[out].mean(0)) @ w
    return 1 - ((y[own] - p) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum()


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_scores_equal_fits_on_the_rows(spark, shift):
    x, y, k = table(shift=shift)
    found = {(r["model"], r["fold"]): r["r2"] for r in folds.linear_scores(frame(spark, x, y, k).repartition(5), 3).collect()}
    assert len(found) == 9
    for (name, fold), r2 in found.items():
        # the reference evidence takes raw products, so it gets the rows without the shift
        assert r2 == pytest.approx(expected(name, x - shift, y, k, fold), abs=1e-7), (name, fold)


def test_rows_without_label_take_no_part(spark):
    x, y, k = table(300)
    gaps = y.copy()
    gaps[::4] = np.nan
    kept = ~np.isnan(gaps)
    whole = folds.linear_scores(frame(spark, x, gaps, k), 3).collect()
    part = folds.linear_scores(frame(spark, x[kept], y[kept], k[kept]), 3).collect()
    for a, b in zip(whole, part):
        assert (a["model"], a["fold"]) == (b["model"], b["fold"]) and a["r2"] == pytest.approx(b["r2"], abs=1e-10)


def test_missing_folds_and_tiny_tables(spark):
    x, y, k = table(40)
    scores = folds.linear_scores(frame(spark, x, y, np.where(k == 2, 1, k)), 4, ["ridge"]).collect()
    assert [r["r2"] is None for r in scores] == [False, False, True, True]
    one = folds.linear_scores(frame(spark, x, y, k * 0), 2, ["ridge"]).collect()  # no training rows for fold 0
    assert [r["r2"] for r in one] == [None, None]
    none = folds.linear_scores(frame(spark, x, y, k).where("false"), 2, ["ridge"]).collect()
    assert [r["r2"] for r in none] == [None, None]
    with pytest.raises(ValueError, match="no linear member"):
        folds.linear_scores(frame(spark, x, y, k), 3, ["forest"])


def test_constant_columns_and_labels(spark):
    x, y, k = table(60)
    flat = np.column_stack([x, np.full(60, 3.0)])
    assert all(r["r2"] is not None for r in folds.linear_scores(frame(spark, flat, y, k), 3).collect())
    same = folds.linear_scores(frame(spark, x, y * 0 + 5, k), 3, ["ridge", "elastic_net"]).collect()
    assert {r["r2"] for r in same} == {1.0}
