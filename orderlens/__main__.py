"""Jobs on one table of order items, for spark-submit or ``python -m orderlens``.

    train    fit the forecaster, print its metrics, save the bundle
    score    predict with a saved bundle, write CSV or parquet
    profile  print types, missing values, statistics, correlations
    ask      answer a keyword question
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from orderlens.columns import FEATURES, ITEM_KEY, ITEM_ORDER, TARGET
from orderlens.functions.expressions import numeric_columns, row_text
from orderlens.operators import keywords, profiling
from orderlens.plans.bundle import load_bundle, save_bundle
from orderlens.plans.forecast import score_table, train
from orderlens.plans.models import MODEL_NAMES, Sizes
from orderlens.sources.files import canonical_columns, check_table, load_table
from orderlens.sources.order_items import order_items
from orderlens.sources.sinks import scored_export, write_full


def _table(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    if options.star:
        return order_items(spark, options.input)
    return canonical_columns(load_table(spark, options.input))


def _train(spark: SparkSession, options: argparse.Namespace) -> None:
    items = _table(spark, options)
    check_table(items, [*FEATURES, TARGET])
    sizes = Sizes(options.trees, options.trees, max(1, options.trees // 2), max(1, options.trees // 2))
    trained = train(items, options.key, options.order, sizes=sizes)
    print(row_text(trained.metrics.first().asDict()))
    save_bundle(trained.bundle, options.output)


def _score(spark: SparkSession, options: argparse.Namespace) -> None:
    items = _table(spark, options)
    scored = score_table(load_bundle(spark, options.model), items, options.order, MODEL_NAMES)
    write_full(scored_export(scored, items.columns), options.output, options.format)


def _profile(spark: SparkSession, options: argparse.Namespace) -> None:
    items = _table(spark, options)
    for table in (
        profiling.column_profile(items, approximate=True),
        profiling.missing_report(items),
        profiling.describe(items),
        profiling.correlations(items, numeric_columns(items)),
    ):
        table.show(200, truncate=False)


def _ask(spark: SparkSession, options: argparse.Namespace) -> None:
    print(keywords.summary_text(_table(spark, options), options.question))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orderlens", description=__doc__)
    jobs = parser.add_subparsers(required=True)
    for name, job in (("train", _train), ("score", _score), ("profile", _profile), ("ask", _ask)):
        command = jobs.add_parser(name)
        command.set_defaults(job=job)
        command.add_argument("input", help="a file or folder, or with --star the folder of the star schema")
        command.add_argument("--star", action="store_true")
        if name in ("train", "score"):
            command.add_argument("output")
            command.add_argument("--order", type=lambda t: t.split(","), default=ITEM_ORDER)
        if name == "train":
            command.add_argument("--key", type=lambda t: t.split(","), default=ITEM_KEY)
            command.add_argument("--trees", type=int, default=Sizes().trees)
        if name == "score":
            command.add_argument("--model", required=True)
            command.add_argument("--format", choices=["csv", "parquet"], default="csv")
        if name == "ask":
            command.add_argument("question")
    options = parser.parse_args(arguments)
    options.job(SparkSession.builder.appName("orderlens").getOrCreate(), options)


if __name__ == "__main__":
    main()
