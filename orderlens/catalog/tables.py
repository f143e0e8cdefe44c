"""Queries on sources, sinks, projections, pages and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.catalog.base import (
    ITEM_ORDER_SQL,
    MODELS,
    closed_form_models,
    gaps,
    on_gaps,
    on_items,
    on_scored,
    query,
    rounded,
)
from orderlens.columns import CATEGORICAL, FEATURES, ITEM_KEY, ITEM_ORDER, NUMERIC
from orderlens.functions.date_formats import infer_date_formats, with_parsed_dates
from orderlens.functions.dates import date_columns, parse_timestamp
from orderlens.operators import paging, projection
from orderlens.operators.ordered import dense_index
from orderlens.operators.predicates import distinct_values
from orderlens.operators.scoring import combine_predictions
from orderlens.plans.bundle import align_to_inputs, unseen_values
from orderlens.session import scratch_path
from orderlens.sources import files, sinks
from orderlens.sources.order_items import order_items

_LATIN_SCHEMA = T.StructType(
    [T.StructField("Market", T.StringType()), T.StructField("Sales", T.DoubleType())]
)


def _write_accented(spark: SparkSession, folder: str, encoding: str) -> str:
    path = scratch_path(spark, "csv")
    items = order_items(spark, folder, ["market", "sales"]).withColumn("market", F.concat(F.lit("é "), "market"))
    files.display_columns(items).write.option("header", True).option("encoding", encoding).csv(path)
    return path


_ACCENTED = on_items(
    "SELECT 'é ' || market AS market, count(*) AS n, round(sum(sales), 2) AS sum_sales FROM items GROUP BY market"
)


def _by_market(df: DataFrame) -> DataFrame:
    return df.groupBy("market").agg(F.count("*").alias("n"), F.round(F.sum("sales"), 2).alias("sum_sales"))


@query(_ACCENTED)
def csv_scan_latin1(spark, folder):
    """SRC1"""
    path = _write_accented(spark, folder, "ISO-8859-1")
    return _by_market(files.canonical_columns(files.read_csv(spark, path, _LATIN_SCHEMA, "ISO-8859-1")))


@query(_ACCENTED)
def csv_encoding_fallback(spark, folder):
    """SRC2, SRC3: the encoding is found from the bytes and the types from the values."""
    path = _write_accented(spark, folder, "ISO-8859-1")
    return _by_market(files.canonical_columns(files.read_csv(spark, path)))


@query(
    on_items(
        "SELECT 'ISO-8859-1' AS written, 'ISO-8859-1' AS detected, count(*) AS n FROM items "
        "UNION ALL SELECT 'UTF-8', 'UTF-8', count(*) FROM items"
    )
)
def csv_encoding_detected(spark, folder):
    """SRC2, SRC3"""
    parts = []
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = _write_accented(spark, folder, encoding)
        found = files.detect_encoding(spark, path)
        rows = files.read_csv(spark, path, _LATIN_SCHEMA, found)
        parts.append(rows.agg(F.lit(encoding).alias("written"), F.lit(found).alias("detected"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


@query(
    on_items(
        "SELECT 'é \"' || market || '\", ' || chr(10) || customer_segment AS note, count(*) AS n, round(sum(sales), 2) AS sum_sales "
        "FROM items GROUP BY market, customer_segment"
    )
)
def csv_round_trip(spark, folder):
    """SRC1, SNK3: accents, quotes, commas and line breaks survive, and a schema goes by names, not by places."""
    path = scratch_path(spark, "round")
    items = order_items(spark, folder, ["sales", "market", "customer_segment"])
    note = F.concat(F.lit('é "'), "market", F.lit('", \n'), "customer_segment").alias("note")
    sinks.write_csv(items.select("sales", note), path)
    schema = T.StructType([T.StructField("note", T.StringType()), T.StructField("sales", T.DoubleType())])
    back = files.read_csv(spark, path, schema)
    return back.groupBy("note").agg(F.count("*").alias("n"), F.round(F.sum("sales"), 2).alias("sum_sales"))


_FORMATS = ["csv", "json", "orc", "parquet"]


@query(
    on_items(
        " UNION ALL ".join(
            f"SELECT '{f}' AS format, count(*) AS n, round(sum(quantity), 2) AS sum_quantity, "
            "round(sum(sales), 2) AS sum_sales FROM items"
            for f in _FORMATS
        )
    )
)
def format_by_extension(spark, folder):
    """SRC4"""
    items = order_items(spark, folder, ["market", "quantity", "sales"])
    parts = []
    for fmt in _FORMATS:
        path = f"{scratch_path(spark, 'format')}.{fmt}"
        sinks.write_full(items, path, fmt)
        parts.append(
            files.load_table(spark, path).agg(
                F.lit(fmt).alias("format"),
                F.count("*").alias("n"),
                F.round(F.sum("quantity"), 2).alias("sum_quantity"),
                F.round(F.sum("sales"), 2).alias("sum_sales"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query(on_items("SELECT count(*) > 0 AS has_rows, 'discount code' AS missing FROM items"))
def table_check(spark, folder):
    """SRC5, SRC6"""
    items = order_items(spark, folder, FEATURES)
    files.check_table(items, FEATURES)
    absent = files.missing_columns(items, [*FEATURES, "discount code"])
    return items.agg((F.count("*") > 0).alias("has_rows"), F.lit(", ".join(absent)).alias("missing"))


@query(
    on_items(
        "SELECT customer_segment, count(*) AS n, round(sum(sales), 2) AS sum_sales FROM items GROUP BY customer_segment"
    )
)
def column_aliases(spark, folder):
    """SRC7"""
    shown = files.display_columns(order_items(spark, folder, ["customer_segment", "sales"]))
    table = files.canonical_columns(shown.withColumnRenamed("Customer Segment", "Customer_Segment"))
    return table.groupBy("customer_segment").agg(
        F.count("*").alias("n"), F.round(F.sum("sales"), 2).alias("sum_sales")
    )


@query(
    on_items(
        "SELECT market AS value, count(*) AS n FROM items GROUP BY market "
        "UNION ALL SELECT customer_segment, count(*) FROM items GROUP BY customer_segment"
    )
)
def table_reuse(spark, folder):
    """SRC8"""
    kept = files.keep_for_reuse(order_items(spark, folder, ["market", "customer_segment"]))
    counts = [
        kept.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in ("market", "customer_segment")
    ]
    return counts[0].unionByName(counts[1])


@query(
    on_scored(
        "SELECT count(*) AS n, round(sum(sales), 2) AS sum_sales, round(sum(combined), 1) AS sum_predicted, "
        "round(avg(uncertainty), 3) AS mean_uncertainty, round(avg(upper - lower), 3) AS mean_width FROM scored"
    )
)
def scored_csv_export(spark, folder):
    """SNK1"""
    scored = combine_predictions(closed_form_models(spark, folder, ["market"]), MODELS, "sigma")
    path = scratch_path(spark, "scored")
    sinks.write_csv(sinks.scored_export(scored, ["market", "sales"]), path)
    back = files.read_csv(spark, path)
    width = F.col("`Upper_Bound_95%`") - F.col("`Lower_Bound_95%`")
    return back.agg(
        F.count("*").alias("n"),
        F.round(F.sum("sales"), 2).alias("sum_sales"),
        F.round(F.sum("Predicted_Sales"), 1).alias("sum_predicted"),
        F.round(F.avg("Prediction_Uncertainty"), 3).alias("mean_uncertainty"),
        F.round(F.avg(width), 3).alias("mean_width"),
    )


@query(
    on_items(
        "SELECT 'asia' AS export, count(*) <= 50000 AS written, count(*) AS n FROM items WHERE market = 'ASIA' "
        "UNION ALL SELECT 'all', count(*) <= 50000, count(*) FROM items"
    )
)
def capped_export(spark, folder):
    """SNK2: a result above the limit is not written, and never cut."""
    parts = []
    for name, rows in (
        ("asia", order_items(spark, folder, ["market", "sales"]).where("market = 'ASIA'")),
        ("all", order_items(spark, folder, ["market", "sales"])),
    ):
        written = sinks.write_capped(rows, scratch_path(spark, "capped"))
        parts.append(rows.agg(F.lit(name).alias("export"), F.lit(written).alias("written"), F.count("*").alias("n")))
    return parts[0].unionByName(parts[1])


@query(on_items("SELECT market, count(*) AS n, round(sum(sales), 2) AS sum_sales FROM items GROUP BY market"))
def full_export(spark, folder):
    """SNK3"""
    path = scratch_path(spark, "full") + ".parquet"
    sinks.write_full(order_items(spark, folder), path, "parquet")
    return _by_market(files.load_table(spark, path))


@query(
    on_scored(
        "SELECT CAST(row_number() OVER (ORDER BY " + ITEM_ORDER_SQL + ") - 1 AS INTEGER) AS \"Index\", "
        "sales AS \"Actual_Sales\", round(combined, 2) AS \"Predicted_Sales\", round(lower, 2) AS \"Lower_Bound\", "
        "round(upper, 2) AS \"Upper_Bound\" FROM scored ORDER BY 1 LIMIT 100"
    )
)
def sample_predictions(spark, folder):
    """SNK4"""
    scored = combine_predictions(closed_form_models(spark, folder, ITEM_ORDER), MODELS, "sigma")
    digits = {"Predicted_Sales": 2, "Lower_Bound": 2, "Upper_Bound": 2}
    return rounded(sinks.sample_predictions(scored, ITEM_ORDER), digits)


@query(
    on_items(
        "SELECT '1.0' AS model_version, count(*) AS n_samples, 12 AS n_features, 'sales' AS target_column, "
        f"'{','.join(CATEGORICAL)}' AS categorical_features, '{','.join(NUMERIC)}' AS numerical_features FROM items"
    )
)
def training_metadata(spark, folder):
    """SNK7: written as JSON and read back."""
    path = scratch_path(spark, "metadata")
    sinks.write_metadata(sinks.training_metadata(order_items(spark, folder, [*FEATURES, "sales"]), FEATURES), path)
    row = sinks.read_metadata(spark, path)
    return row.select(
        "model_version",
        "n_samples",
        "n_features",
        "target_column",
        F.concat_ws(",", "categorical_features").alias("categorical_features"),
        F.concat_ws(",", "numerical_features").alias("numerical_features"),
    )


_KEY = ", ".join(ITEM_KEY)


@query(on_items(f"SELECT {_KEY}, {', '.join(FEATURES)} FROM items"))
def projection_features(spark, folder):
    """P1"""
    return projection.project(order_items(spark, folder), [*ITEM_KEY, *FEATURES])


@query(on_items(f"SELECT {_KEY}, {', '.join(CATEGORICAL)} FROM items"))
def projection_without_target(spark, folder):
    """P2"""
    return projection.without_target(order_items(spark, folder, [*ITEM_KEY, *CATEGORICAL, "sales"]))


@query(on_gaps(f"SELECT {_KEY}, market, sales FROM gaps WHERE sales IS NOT NULL"))
def rows_with_target(spark, folder):
    """P3"""
    return projection.with_target_only(gaps(spark, folder, [*ITEM_KEY, "market", "sales"]))


@query(on_gaps(f"SELECT {_KEY}, coalesce(benefit, 0) AS benefit, coalesce(sales, 0) AS sales FROM gaps"))
def numeric_only_zero_filled(spark, folder):
    """P4"""
    return projection.numeric_only(gaps(spark, folder, [*ITEM_KEY, "market", "benefit", "sales"]))


@query(on_items(f"SELECT {_KEY}, quantity, 0 AS warehouse, sales FROM items"))
def reindexed_features(spark, folder):
    """P5"""
    return projection.reindex(
        order_items(spark, folder, ["sales", "quantity", *ITEM_KEY]), [*ITEM_KEY, "quantity", "warehouse", "sales"]
    )


@query(
    on_gaps(
        "SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(line_no AS VARCHAR) AS line_no, "
        "CAST(part_id AS VARCHAR) AS part_id, CAST(supplier_id AS VARCHAR) AS supplier_id, market, sales FROM gaps"
    )
)
def display_texts(spark, folder):
    """P6"""
    return projection.display_texts(gaps(spark, folder, [*ITEM_KEY, "market", "sales"]))


@query(on_gaps("SELECT market, count(*) AS n, count(sales) AS n_sales FROM gaps GROUP BY market"))
def non_empty_columns(spark, folder):
    """The all-NULL column is not offered."""
    table = gaps(spark, folder, ["market", "sales"]).withColumn("empty", F.lit(None).cast("string"))
    offered = projection.offered_columns(table)
    assert "empty" not in offered.columns
    return offered.groupBy("market").agg(F.count("*").alias("n"), F.count("sales").alias("n_sales"))


def _record_sql(position: int) -> str:
    lines = [
        f"SELECT '{c}' AS name, '{'categorical' if c in CATEGORICAL else 'numeric'}' AS kind, "
        f"CAST({c} AS VARCHAR) AS value FROM picked"
        for c in FEATURES
    ]
    picked = f"picked AS (SELECT * FROM items ORDER BY {ITEM_ORDER_SQL} LIMIT 1 OFFSET {position})"
    return on_items(" UNION ALL ".join(lines), picked)


@query(_record_sql(42))
def record_features(spark, folder):
    """P8, L3"""
    picked = order_items(spark, folder, pick=lambda lines: paging.record(lines, ITEM_ORDER, 42))
    return paging.unpivot_record(picked.select(*FEATURES, "sales"))


@query(
    on_items(
        "SELECT count(*) AS n, count(CASE WHEN market = 'ASIA' THEN 1 END) AS new_market, "
        "count(CASE WHEN order_region IN (SELECT order_region FROM items WHERE market = 'ASIA') THEN 1 END) AS new_region, "
        "CAST(0 AS BIGINT) AS new_segment, count(CASE WHEN quantity <> 13 THEN 1 END) AS n_quantity FROM items"
    )
)
def aligned_inputs(spark, folder):
    """Inputs arrive as texts; unreadable numbers become NULL and unseen values are counted."""
    items = order_items(spark, folder, [*FEATURES, "sales"])
    quantity = F.when(F.col("quantity") == 13, "thirteen").otherwise(F.col("quantity").cast("string"))
    arrived = items.select(*[F.col(c).cast("string").alias(c) for c in FEATURES if c != "quantity"], quantity.alias("quantity"))
    watched = ["market", "order_region", "customer_segment"]
    seen: dict[str, list[str]] = {c: [] for c in watched}
    for row in distinct_values(items.where("market <> 'ASIA'"), watched).collect():
        seen[row["column"]].append(row["value"])
    aligned = align_to_inputs(arrived)
    counts = aligned.agg(F.count("*").alias("n"), F.count("quantity").alias("n_quantity"))
    unseen = unseen_values(aligned, seen).select(F.struct(*watched)).scalar()
    return counts.select(
        "n",
        unseen["market"].alias("new_market"),
        unseen["order_region"].alias("new_region"),
        unseen["customer_segment"].alias("new_segment"),
        "n_quantity",
    )


_PAGE = f"{_KEY}, ts, market, sales"
_PAGE_COLUMNS = [*ITEM_ORDER, "market"]


@query(on_items(f"SELECT {_PAGE} FROM items ORDER BY {ITEM_ORDER_SQL} LIMIT 100"))
def head_rows(spark, folder):
    """L1"""
    items = order_items(spark, folder, _PAGE_COLUMNS, pick=lambda lines: paging.head(lines, ITEM_ORDER, 100))
    return items.orderBy(*ITEM_ORDER).select(*ITEM_KEY, "ts", "market", "sales")


@query(on_items(f"SELECT {_PAGE} FROM items ORDER BY {ITEM_ORDER_SQL} LIMIT 50 OFFSET 400"))
def page_rows(spark, folder):
    """L2"""
    items = order_items(spark, folder, _PAGE_COLUMNS, pick=lambda lines: paging.page(lines, ITEM_ORDER, 400, 50))
    return items.orderBy(*ITEM_ORDER).select(*ITEM_KEY, "ts", "market", "sales")


@query(on_items(f"SELECT {_PAGE} FROM items ORDER BY {ITEM_ORDER_SQL} LIMIT 200 OFFSET 3000"))
def deep_page_rows(spark, folder):
    """L2 beyond the depth where the first rows of every partition would be kept."""
    items = order_items(spark, folder, _PAGE_COLUMNS, pick=lambda lines: paging.page(lines, ITEM_ORDER, 3000, 200))
    return items.orderBy(*ITEM_ORDER).select(*ITEM_KEY, "ts", "market", "sales")


_RANDOM = " || '|' || ".join(["'42'", *[f"CAST({c} AS VARCHAR)" for c in ITEM_KEY]])


@query(on_items(f"SELECT {_PAGE} FROM items ORDER BY md5({_RANDOM}), {_KEY} LIMIT 1"))
def random_record(spark, folder):
    """L5"""
    items = order_items(spark, folder, _PAGE_COLUMNS, pick=lambda lines: paging.random_record(lines, ITEM_KEY))
    return items.select(*ITEM_KEY, "ts", "market", "sales")


@query(
    "SELECT event_id, TRY_CAST(CASE WHEN event_type <> 'error' THEN CAST(ts AS VARCHAR) ELSE 'unknown' END AS TIMESTAMP) AS ts, "
    "row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events"
)
def parsed_dates(spark, folder):
    """The timestamp of a text, NULL where unreadable, beside the row number."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("ts").cast("string")).otherwise("unknown").alias("text")
    )
    stamp = parse_timestamp(F.col("text")).cast("timestamp_ntz").alias("ts")
    return dense_index(events, ["event_id"], "idx").select("event_id", stamp, "idx")


@query(
    on_items(
        "SELECT unnest(['order_date', 'ship_time']) AS name, count(*) AS n FROM items"
    )
)
def date_columns_found(spark, folder):
    """A date by type or by content, not by name alone."""
    items = order_items(spark, folder, ["ts", "market", "days_real"]).select(
        F.col("ts").cast("string").alias("order_date"),
        F.col("ts").alias("ship_time"),
        F.col("market").alias("day_note"),
        "days_real",
        "market",
    )
    found = date_columns(items)
    return items.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in found])).alias("name"), "n")


@query(
    on_items(
        "SELECT order_id, line_no, CASE WHEN order_id % 5 <> 4 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS sold, "
        "count(*) OVER () - count(CASE WHEN order_id % 5 = 4 THEN 1 END) OVER () AS n_read, "
        "0::BIGINT AS n_conflicting FROM items"
    )
)
def mixed_date_formats(spark, folder):
    """A text column in four formats, one with the day first, and with texts that are no dates."""
    items = order_items(spark, folder, ["order_id", "line_no", "ts"])
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "M-d-yyyy"]
    text = F.lit("not yet")
    for place, form in enumerate(forms):
        text = F.when(F.col("order_id") % 5 == place, F.date_format("ts", form)).otherwise(text)
    texts = items.select("order_id", "line_no", text.alias("sold"))
    found = infer_date_formats(texts, ["sold"])
    how = found["sold"]
    return with_parsed_dates(texts, found).select(
        "order_id",
        "line_no",
        "sold",
        F.lit(how.texts - how.unread).cast("long").alias("n_read"),
        F.lit(how.conflicting).cast("long").alias("n_conflicting"),
    )
