"""From order items to a feature vector: splits, imputing, scaling, encoding, selection.

Everything learned is learned from the training rows only and stored in one
``PipelineModel`` of stock stages, so that serving repeats exactly what training did.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    Bucketizer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    UnivariateFeatureSelector,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.columns import CATEGORICAL, NUMERIC, TARGET
from orderlens.functions.expressions import EPSILON, hash_bucket, quoted
from orderlens.operators.categories import NO_VALUE, frequent_values
from orderlens.operators.predicates import distinct_values
from orderlens.operators.quantiles import approximate_quantiles, exact_quantiles

# Seed, split shares in percent, number of folds, features to keep.
SEED = 42
TRAIN, VALIDATION, TEST = 60, 20, 20
FOLDS = 5
BEST_FEATURES = 150

# Values of a categorical column that get an entry of the feature vector each.
MAX_CATEGORIES = 10_000
# Steps of the stored percentile curve.
PERCENTILE_STEPS = 200


def with_split(df: DataFrame, key: Sequence[str], seed: int = SEED, name: str = "split") -> DataFrame:
    """Assign every row to train, validation or test by the hash of its key: no shuffle, same on every run."""
    bucket = hash_bucket(key, TRAIN + VALIDATION + TEST, seed)
    label = F.when(bucket < TRAIN, "train").when(bucket < TRAIN + VALIDATION, "validation").otherwise("test")
    return df.withColumn(name, label)


def with_fold(
    df: DataFrame, key: Sequence[str], folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Assign every row to a fold by the hash of its key, independently of the split."""
    return df.withColumn(name, hash_bucket([*key], folds, seed + 1))


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULLs with the exact median of the column."""
    medians = exact_quantiles(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(medians[c][0])) for c in columns})


def robust_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - median) / IQR with exact quartiles; a zero IQR scales by one, no values give none."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    scaled = {}
    for name in columns:
        # a column without values stays without values
        q25, q50, q75 = (q if q is not None else 0.0 for q in quartiles[name])
        scaled[f"{name}{suffix}"] = (quoted(name) - F.lit(q50)) / F.lit((q75 - q25) or 1.0)
    return df.withColumns(scaled)


def _number(value: float) -> str:
    return f"{value!r}D"


def _select(expressions: Sequence[str]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")


def _row_feature_stage(numeric: Sequence[str], categorical: Sequence[str]) -> SQLTransformer:
    parts = [f"coalesce({c}, '{NO_VALUE}') AS {c}_filled" for c in categorical]
    for c in numeric:
        parts += [f"{c} * {c} AS {c}_squared", f"log1p(abs({c})) AS {c}_log"]
    if {"sales_per_customer", "quantity"} <= set(numeric):
        parts.append("sales_per_customer * quantity AS sales_quantity_interaction")
    if {"days_real", "benefit"} <= set(numeric):
        parts.append(f"try_divide(days_real, benefit + {_number(EPSILON)}) AS shipping_benefit_ratio")
    return _select(parts)


def _zscore_stage(train: DataFrame, numeric: Sequence[str]) -> SQLTransformer:
    row = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in numeric], *[F.stddev_samp(c).alias(f"std_{c}") for c in numeric]
    ).first()
    parts = []
    for c in numeric:
        mean, std = row[f"mean_{c}"] or 0.0, row[f"std_{c}"] or 0.0
        parts.append(f"({c} - {_number(mean)}) / {_number(std + EPSILON)} AS {c}_zscore")
    return _select(parts)


def _percentile_stages(train: DataFrame, numeric: Sequence[str], steps: int) -> list:
    """Percentile of a value among the training rows, read from a stored curve of bounded size.

    The curve has a step at each of up to ``steps`` quantiles; a step holds the exact average rank
    of the training rows on it, so a value is off its exact rank by the rows of its step at most,
    about 1 / ``steps`` beyond what a single value holds.
    """
    shares = [i / steps for i in range(steps + 1)]
    marks = approximate_quantiles(train, numeric, shares)
    inner = {c: sorted({m for m in marks[c] if m is not None and math.isfinite(m)}) or [0.0] for c in numeric}
    bucketizer = Bucketizer(
        splitsArray=[[-float("inf"), *inner[c], float("inf")] for c in numeric],
        inputCols=list(numeric),
        outputCols=[f"{c}_step" for c in numeric],
        handleInvalid="keep",
    )
    placed = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"{c}_step").cast("int").alias("step")) for c in numeric]
    )
    counted = (
        bucketizer.transform(train)
        .select(F.inline(placed))
        .where(F.col("step").isNotNull())
        .groupBy("column", "step")
        .count()
        .collect()
    )
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for row in counted:
        counts[row["column"]][row["step"]] = row["count"]
    parts = []
    for c in numeric:
        total = sum(counts[c].values()) or 1
        below, curve = 0, []
        for step in range(len(inner[c]) + 1):
            here = counts[c].get(step, 0)
            curve.append((below + (here + 1) / 2) / total if here else below / total)
            below += here
        literals = ", ".join(_number(v) for v in curve)
        parts.append(f"try_element_at(array({literals}), int({c}_step) + 1) AS {c}_percentile")
    return [bucketizer, _select(parts)]


def numeric_feature_names(numeric: Sequence[str] = NUMERIC, trailing: bool = True) -> list[str]:
    names = list(numeric)
    for c in numeric:
        names += [f"{c}_squared", f"{c}_log"]
    if {"sales_per_customer", "quantity"} <= set(numeric):
        names.append("sales_quantity_interaction")
    if {"days_real", "benefit"} <= set(numeric):
        names.append("shipping_benefit_ratio")
    for c in numeric:
        names += [f"{c}_percentile", f"{c}_zscore"] + ([f"{c}_ma"] if trailing else [])
    return names


def _scale_stage(train: DataFrame, names: Sequence[str], exact: bool, keep: bool = True) -> SQLTransformer:
    marks = [0.25, 0.5, 0.75]
    quartiles = exact_quantiles(train, names, marks, keep=keep) if exact else approximate_quantiles(train, names, marks)
    parts = []
    for c in names:
        q25, q50, q75 = (q if q is not None else 0.0 for q in quartiles[c])
        scale = (q75 - q25) or 1.0
        parts.append(f"(coalesce({c}, {_number(q50)}) - {_number(q50)}) / {_number(scale)} AS {c}_scaled")
    return _select(parts)


def fit_preparation(
    train: DataFrame,
    numeric: Sequence[str] = NUMERIC,
    categorical: Sequence[str] = CATEGORICAL,
    target: str = TARGET,
    trailing: bool = True,
    exact_quartiles: bool = True,
    best: int = BEST_FEATURES,
    percentile_steps: int = PERCENTILE_STEPS,
    max_categories: int = MAX_CATEGORIES,
    refuse_wide: bool = False,
    keep: bool = True,
) -> PipelineModel:
    """Learn the whole preparation from the training rows; the result adds a ``features`` vector.

    With ``trailing`` the rows must carry the trailing means (``*_ma``), which need the order
    of the whole table and are therefore computed before. Quartiles for imputing and scaling are
    exact, as in ``median_impute`` and ``robust_scale``; with ``exact_quartiles=False`` they come
    from one bounded sketch pass. ``percentile_steps`` is the size of the stored percentile curve.
    Of a column with more than ``max_categories`` distinct values, by exact count, those with the most
    rows get a column of the vector each, all others and unknown ones share one; with ``refuse_wide``
    such a column is an error. The F scores are computed only if there are more than ``best`` features
    to choose from. ``keep=False`` is for rows that are a plain scan: their features are made anew in every pass.
    """
    stages = [_row_feature_stage(numeric, categorical)]
    rows = stages[0].transform(train)
    stages.append(_zscore_stage(rows, numeric))
    stages += _percentile_stages(rows, numeric, percentile_steps)
    for stage in stages[1:]:
        rows = stage.transform(rows)
    names = numeric_feature_names(numeric, trailing)
    stages.append(_scale_stage(rows, names, exact_quartiles, keep))
    rows = stages[-1].transform(rows)

    encoded = []
    if categorical:
        if refuse_wide:
            _check_categories(rows, categorical, max_categories)
        encoders = _category_stages(rows, categorical, max_categories)
        for stage in encoders:
            rows = stage.transform(rows)
        stages += encoders
        encoded = [f"{c}_onehot" for c in categorical]

    inputs = [*encoded, *[f"{c}_scaled" for c in names]]
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    if len(feature_names(assembled)) <= best:
        return PipelineModel([*stages, VectorAssembler(inputCols=inputs, outputCol="features")])
    assembler = VectorAssembler(inputCols=inputs, outputCol="all_features")
    selector = best_features("all_features", target, "features", best).fit(assembler.transform(rows))
    return PipelineModel([*stages, assembler, selector])


def best_features(features: str, target: str, output: str, best: int) -> UnivariateFeatureSelector:
    """The ``best`` features by univariate linear F score."""
    selector = UnivariateFeatureSelector(
        featuresCol=features, labelCol=target, outputCol=output, selectionMode="numTopFeatures"
    )
    return selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(best)


def _category_stages(rows: DataFrame, categorical: Sequence[str], most: int) -> list:
    """Index and one-hot stages; a column with more than ``most`` values gets one more level for all the others."""
    filled = [f"{c}_filled" for c in categorical]
    frequent = frequent_values(rows, filled, most)
    wide = [c for c in categorical if frequent[f"{c}_filled"] is not None]
    narrow = [c for c in categorical if c not in wide]
    stages: list = []
    if narrow:
        indexer = StringIndexer(
            inputCols=[f"{c}_filled" for c in narrow],
            outputCols=[f"{c}_index" for c in narrow],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        )
        stages.append(indexer.fit(rows))
    if wide:
        labels = [frequent[f"{c}_filled"] for c in wide]
        indexed = [f"{c}_index" for c in wide]
        stages.append(
            StringIndexerModel.from_arrays_of_labels(labels, [f"{c}_filled" for c in wide], indexed, handleInvalid="keep")
        )
    for stage in stages:
        rows = stage.transform(rows)
    # The index after the known values stands for all others. Where every value of the training rows has
    # an index, dropping it leaves unknown ones all zeros; else it is the level that rare and unknown ones share.
    for names, drop in ((narrow, True), (wide, False)):
        if names:
            inputs, outputs = [f"{c}_index" for c in names], [f"{c}_onehot" for c in names]
            stages.append(OneHotEncoder(inputCols=inputs, outputCols=outputs, dropLast=drop).fit(rows))
    return stages


def _check_categories(df: DataFrame, categorical: Sequence[str], limit: int) -> None:
    """Refuse columns with more than ``limit`` distinct values, by exact count."""
    counts = distinct_values(df, categorical).groupBy("column").count()
    large = sorted(row["column"] for row in counts.where(F.col("count") > limit).collect())
    if large:
        raise ValueError(f"too many distinct values for one-hot encoding: {large}")


def feature_names(prepared: DataFrame) -> list[str]:
    """Names of the vector's entries in order, from the attributes that encoder, assembler and selector attach."""
    attributes = prepared.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    entries = [a for kind in attributes.values() for a in kind]
    return [a.get("name", f"feature_{a['idx']}") for a in sorted(entries, key=lambda a: a["idx"])]
