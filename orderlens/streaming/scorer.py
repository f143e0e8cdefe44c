"""Scoring files as they arrive, with a stored forecaster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderlens.functions.expressions import nan_to_null
from orderlens.operators.scoring import combine_predictions
from orderlens.plans.bundle import Bundle, score
from orderlens.plans.models import MODEL_NAMES


def arriving_rows(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return nan_to_null(spark.readStream.schema(schema).format(fmt).load(folder))


def scored_stream(bundle: Bundle, rows: DataFrame, names: Sequence[str] = MODEL_NAMES) -> DataFrame:
    """Predictions and intervals row by row; nothing is kept between rows, so there is no state.

    A model with trailing means is refused: a mean over the last rows of a whole ordered
    table has no meaning for rows that arrive in any order.
    """
    if bundle.needs_order:
        raise ValueError("this model reads trailing means; train one without them for streams")
    return combine_predictions(score(bundle, rows), names, "sigma")


def score_arriving_files(
    scored: DataFrame, columns: Sequence[str], path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Append the scored rows to files; a restart goes on from the checkpoint without loss or repetition."""
    return (
        scored.select(*columns)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
