"""The regressors of the ensemble, their evaluation by folds and their importances."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.columns import TARGET
from orderlens.functions.expressions import Z95
from orderlens.operators.scoring import PRIMARY_SHARE
from orderlens.plans.growth import Growth
from orderlens.plans.preparation import SEED
from orderlens.plans.trees import fit_together, fold_r2

# Sizes and strengths of the regressors.
TREES, TREE_DEPTH, LEAF_ROWS, SPLIT_ROWS = 200, 10, 5, 10
BOOST_ROUNDS, BOOST_DEPTH, LEARNING_RATE = 200, 6, 0.1
ROW_SHARE, FEATURE_SHARE, LEAF_L1, LEAF_L2 = 0.8, 0.8, 0.1, 0.1
NET_ALPHA, NET_MIX = 0.1, 0.5
RIDGE_ALPHA = 1.0
IMPORTANCE_TREES = FOLD_TREES = 100
IMPORTANCE_RATE, IMPORTANCE_L2 = 0.3, 1.0

MODEL_NAMES = [
    "random_forest",
    "boosting_subsampled",
    "gradient_boosting",
    "elastic_net",
    "ridge",
    "bayesian_ridge",
]


@dataclass(frozen=True)
class Sizes:
    """Tree counts, the one setting that is scaled down for quick runs."""

    trees: int = TREES
    rounds: int = BOOST_ROUNDS
    importance_trees: int = IMPORTANCE_TREES
    fold_trees: int = FOLD_TREES


def tree_growths(sizes: Sizes = Sizes()) -> dict[str, Growth]:
    """How the trees of the three tree members grow."""
    boosted = {"trees": sizes.rounds, "depth": BOOST_DEPTH, "rate": LEARNING_RATE, "row_share": ROW_SHARE, "seed": SEED}
    return {
        "random_forest": Growth(sizes.trees, TREE_DEPTH, bootstrap=True, leaf_rows=LEAF_ROWS, split_rows=SPLIT_ROWS, seed=SEED),
        "boosting_subsampled": Growth(**boosted, feature_share=FEATURE_SHARE, l1=LEAF_L1, l2=LEAF_L2),
        "gradient_boosting": Growth(**boosted),
    }


def _linear(label: str, name: str, strength: float, mix: float) -> Estimator:
    """Linear model solved from the products of the columns: one pass over the rows, however many iterations.

    Spark divides the label by its population deviation before solving, which changes the L2
    strength but not the L1 strength; the callers pass strengths that undo it.
    """
    return LinearRegression(
        labelCol=label,
        predictionCol=name,
        regParam=strength,
        elasticNetParam=mix,
        standardization=False,
        solver="normal",
        tol=1e-12,
        maxIter=1000,
    )


def label_stats(train: DataFrame, label: str = TARGET) -> tuple[int, float]:
    row = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return row["n"], row["sd"] or 1.0


def elastic_net(sd: float, label: str = TARGET, name: str = "elastic_net") -> Estimator:
    l1 = NET_ALPHA * NET_MIX
    l2 = NET_ALPHA * (1 - NET_MIX) * sd
    return _linear(label, name, l1 + l2, l1 / (l1 + l2))


def ridge(n: int, sd: float, label: str = TARGET, name: str = "ridge", alpha: float = RIDGE_ALPHA) -> Estimator:
    """Ridge with the penalty ``alpha`` on the sum of squared errors; Spark's is on their mean."""
    return _linear(label, name, alpha * sd / n, 0.0)


def gram_matrix(train: DataFrame, label: str, features: str = "features") -> np.ndarray:
    """Products of all feature, label and constant columns, summed over the rows on the executors."""
    joined = VectorAssembler(inputCols=[features, label, "_one"], outputCol="_row").transform(
        train.withColumn("_one", F.lit(1.0))
    )
    rows = MLUtils.convertVectorColumnsFromML(joined.select("_row"), "_row")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def evidence_penalty(gram: np.ndarray, iterations: int = 300, tolerance: float = 1e-3) -> float:
    """Ridge penalty that maximises the evidence of a Bayesian linear model.

    Works on the p x p products only: MacKay's fixed-point updates of the noise precision
    and the weight precision, both with a vague Gamma(1e-6, 1e-6) prior.

    Directions in which the columns vary by no more than the rounding of the sums, such as one-hot
    columns that add up to one, tell nothing and are left out: dividing what rounding left of them
    by a small penalty would grow without bound. They are sought among columns brought to equal
    spread, so that a column with a few huge values hides no other.
    """
    n = gram[-1, -1]
    means = gram[-1, :-1] / n
    centred = gram[:-1, :-1] - n * np.outer(means, means)
    xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    rounding = 10 * len(gram) * math.sqrt(n) * np.finfo(float).eps  # ten times what random errors of n additions leave
    varies = np.diag(xx) > rounding * np.diag(gram)[:-2]
    spread = np.sqrt(np.diag(xx)[varies])
    shares, axes = np.linalg.eigh(xx[np.ix_(varies, varies)] / np.outer(spread, spread))
    real = shares > rounding
    axes, lengths = axes[:, real], np.sqrt(shares[real])
    # xx is factor @ factor.T and xy is factor @ fit, without what is left out
    fit = axes.T @ (xy[varies] / spread) / lengths
    vectors, roots, turn = np.linalg.svd(spread[:, None] * axes * lengths, full_matrices=False)
    fit, values = turn @ fit, roots**2
    unexplained = max(yy - fit @ fit, 0.0)
    prior = 1e-6
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    previous = None
    for _ in range(iterations):
        penalised = values + weight / noise
        coefficients = roots * fit / penalised
        squared_error = unexplained + np.sum((fit * (weight / noise) / penalised) ** 2)
        effective = np.sum(values / penalised)
        weight = (effective + 2 * prior) / (coefficients @ coefficients + 2 * prior)
        noise = (n - effective + 2 * prior) / (squared_error + 2 * prior)
        if previous is not None and np.abs(vectors @ (coefficients - previous)).sum() < tolerance:
            break
        previous = coefficients
    return float(weight / noise)


def bayesian_ridge(
    train: DataFrame, n: int, sd: float, label: str = TARGET, name: str = "bayesian_ridge"
) -> Estimator:
    """A ridge whose penalty comes from the evidence: its weights are the posterior means."""
    return ridge(n, sd, label, name, evidence_penalty(gram_matrix(train, label)))


def linear_estimator(name: str, train: DataFrame, label: str = TARGET) -> Estimator:
    n, sd = label_stats(train, label)
    if name == "elastic_net":
        return elastic_net(sd, label)
    if name == "ridge":
        return ridge(n, sd, label)
    if name == "bayesian_ridge":
        return bayesian_ridge(train, n, sd, label)
    raise ValueError(f"unknown model: {name}")


def fit_models(
    train: DataFrame, names: Sequence[str] = MODEL_NAMES, label: str = TARGET, sizes: Sizes = Sizes()
) -> list[Model]:
    """Fit the regressors: the tree models side by side, the linear ones each in one pass. ``train`` should be persisted."""
    growths = {name: growth for name, growth in tree_growths(sizes).items() if name in names}
    fitted: dict[str, Model] = dict(fit_together(train, growths, label)) if growths else {}
    return [fitted[name] if name in fitted else linear_estimator(name, train, label).fit(train) for name in names]


def ensemble_stage(
    names: Sequence[str] = MODEL_NAMES, weights: Sequence[float] | None = None, primary: str = "gradient_boosting"
) -> SQLTransformer:
    """Weighted mean of the models and its blend with the primary one."""
    weights = list(weights) if weights is not None else [1.0] * len(names)
    total = sum(weights)
    mean = " + ".join(f"{n} * double('{w / total!r}')" for n, w in zip(names, weights))
    blended = f"double('{PRIMARY_SHARE!r}') * {primary} + double('{1 - PRIMARY_SHARE!r}') * ({mean})"
    return SQLTransformer(statement=f"SELECT *, {mean} AS ensemble, {blended} AS prediction FROM __THIS__")


def fit_sigma(held_out: DataFrame, label: str = TARGET, rounds: int = BOOST_ROUNDS) -> Model:
    """Model of the error size: absolute residual on held-out rows, scaled to a normal deviation."""
    residuals = held_out.withColumn("_residual", F.abs(F.col(label) - F.col("prediction")) * math.sqrt(math.pi / 2))
    growth = tree_growths(Sizes(rounds=rounds))["gradient_boosting"]
    return fit_together(residuals, {"raw_sigma": growth}, "_residual")["raw_sigma"]


def interval_stage(z: float = Z95) -> SQLTransformer:
    return SQLTransformer(
        statement="SELECT *, abs(raw_sigma) AS sigma, "
        f"prediction - {z} * abs(raw_sigma) AS prediction_lower, "
        f"prediction + {z} * abs(raw_sigma) AS prediction_upper FROM __THIS__"
    )


def fit_forecaster(
    train: DataFrame,
    held_out: DataFrame,
    names: Sequence[str] = MODEL_NAMES,
    label: str = TARGET,
    sizes: Sizes = Sizes(),
    primary: str = "gradient_boosting",
) -> PipelineModel:
    """Regressors, ensemble, blend, error model and interval over prepared rows, as one pipeline."""
    models: list = fit_models(train, names, label, sizes)
    models.append(ensemble_stage(names, primary=primary))
    scored = PipelineModel(models).transform(held_out)
    return PipelineModel([*models, fit_sigma(scored, label, sizes.rounds), interval_stage()])


def cross_validate(
    rows: DataFrame, folds: int, label: str = TARGET, trees: int = FOLD_TREES, fold: str = "fold"
) -> DataFrame:
    """R² per fold of a forest fitted on the other folds; all folds grow side by side over one binned table.

    Trees see the order of the values only, so a scale or a curve that all folds share tells them nothing.
    """
    growth = Growth(trees, TREE_DEPTH, bootstrap=True, seed=SEED)
    return rows.sparkSession.createDataFrame(fold_r2(rows, growth, folds, label, fold), f"{fold} int, r2 double")


def feature_importance(
    train: DataFrame, names: Sequence[str], label: str = TARGET, trees: int = IMPORTANCE_TREES
) -> DataFrame:
    """Importance of every feature in a forest and in boosted trees, fitted side by side, and their mean."""
    growths = {
        "forest": Growth(trees, TREE_DEPTH, bootstrap=True, seed=SEED),
        "boosted": Growth(trees, BOOST_DEPTH, rate=IMPORTANCE_RATE, l2=IMPORTANCE_L2, seed=SEED),
    }
    fitted = fit_together(train, growths, label)
    forest, boosted = (fitted[name].importances() for name in growths)
    rows = [
        (i, names[i], float(f), float(b), float((f + b) / 2)) for i, (f, b) in enumerate(zip(forest, boosted))
    ]
    return train.sparkSession.createDataFrame(
        rows, "index int, feature string, forest double, boosted double, combined double"
    )
