"""Queries on filters, keyword questions, profiles and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.base import (
    MODELS,
    closed_form_models,
    gaps,
    on_gaps,
    on_items,
    on_scored,
    query,
    rounded,
)
from orderlens.columns import CATEGORICAL, ITEM_KEY, NUMERIC
from orderlens.operators import keywords, predicates, profiling
from orderlens.operators.scoring import combine_predictions
from orderlens.sources.order_items import ITEM_COLUMNS, order_items

_ROW = ", ".join([*ITEM_KEY, "sales"])


def _rows(spark, folder, *more):
    return order_items(spark, folder, list(dict.fromkeys([*ITEM_KEY, "sales", *more])))


@query(
    on_items(
        "SELECT customer_segment, count(sales) AS n_sales, round(sum(sales), 2) AS sum_sales, "
        "round(avg(sales), 4) AS mean_sales FROM items "
        "WHERE market IN ('ASIA', 'EUROPE') AND sales BETWEEN 10000 AND 90000 GROUP BY customer_segment"
    )
)
def segment_sales_in_markets(spark, folder):
    """The flagship: filters F1 and F2, then A2 and A4 per segment."""
    items = order_items(spark, folder, ["market", "customer_segment", "sales"])
    kept = predicates.apply_filters(items, {"market": ["ASIA", "EUROPE"], "sales": (10000.0, 90000.0)})
    return rounded(profiling.group_stats(kept, "customer_segment", limit=None), {"sum_sales": 2, "mean_sales": 4})


# ---- filters and conditions


@query(on_gaps(f"SELECT {_ROW} FROM gaps WHERE sales >= 20000 AND sales <= 60000"))
def filter_range(spark, folder):
    """F1"""
    return predicates.apply_filters(gaps(spark, folder, [*ITEM_KEY, "sales"]), {"sales": (20000.0, 60000.0)})


@query(on_items(f"SELECT {_ROW}, market FROM items WHERE market IN ('ASIA', 'EUROPE')"))
def filter_membership(spark, folder):
    """the empty list of types and the unknown column do not filter."""
    filters = {"market": ["ASIA", "EUROPE"], "type": [], "warehouse": ["A"]}
    return predicates.apply_filters(_rows(spark, folder, "market", "type"), filters).drop("type")


@query(
    on_items(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", min({c}) AS lo, max({c}) AS hi FROM items' for c in ["sales", *NUMERIC]
        )
    )
)
def default_range_bounds(spark, folder):
    """the constant column has no range."""
    items = order_items(spark, folder, ["sales", *NUMERIC]).withColumn("constant", F.lit(1.0))
    return predicates.range_bounds(items, ["sales", *NUMERIC, "constant"])


@query(
    on_items(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_values, '
            f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS options FROM items HAVING count(DISTINCT {c}) <= 20"
            for c in ["market", "customer_segment", "shipping_mode", "order_region", "type"]
        )
    )
)
def filterable_categoricals(spark, folder):
    """the 25 order regions are too many for a filter."""
    items = order_items(spark, folder, CATEGORICAL)
    return predicates.filterable_categoricals(items).withColumn("options", F.concat_ws(",", "options"))


@query(
    on_items(
        "SELECT count(*) AS total, count(CASE WHEN hit THEN 1 END) AS kept, "
        "count(CASE WHEN hit THEN 1 END) * CAST(100 AS DOUBLE) / count(*) AS ratio "
        "FROM (SELECT market IN ('ASIA', 'EUROPE') AND sales BETWEEN 10000 AND 90000 AS hit FROM items)"
    )
)
def filter_ratio(spark, folder):
    """F5"""
    items = order_items(spark, folder, ["market", "sales"])
    wanted = {"market": ["ASIA", "EUROPE"], "sales": (10000.0, 90000.0)}
    return predicates.filter_ratio(items, predicates.filter_predicate(items, wanted))


def _where(df, *conditions, **options):
    named = [dict(zip(("column", "operator", "value"), c)) for c in conditions]
    return predicates.apply_conditions(df, named, **options)


@query(on_gaps(f"SELECT {_ROW}, market FROM gaps WHERE market = 'ASIA'"))
def condition_equal(spark, folder):
    """F6"""
    return _where(gaps(spark, folder, [*ITEM_KEY, "sales", "market"]), ("market", "==", "ASIA"))


@query(on_gaps(f"SELECT {_ROW}, market FROM gaps WHERE market IS DISTINCT FROM 'ASIA'"))
def condition_not_equal_keeps_nulls(spark, folder):
    """F7"""
    return _where(gaps(spark, folder, [*ITEM_KEY, "sales", "market"]), ("market", "!=", "ASIA"))


@query(
    on_gaps(
        " UNION ALL ".join(
            f"SELECT '{o}' AS operator, count(*) AS n, round(sum(sales), 2) AS sum_sales FROM gaps WHERE sales {o} 53054.5"
            for o in (">", "<", ">=", "<=")
        )
    )
)
def condition_comparisons(spark, folder):
    """F8: all four operators against a value given as text."""
    table = gaps(spark, folder, ["sales"])
    tests = {o: predicates.condition_predicate(table, "sales", o, "53054.5") for o in (">", "<", ">=", "<=")}
    marked = table.select(
        F.col("sales"), F.explode(F.array(*[F.when(t, F.lit(o)) for o, t in tests.items()])).alias("operator")
    )
    return (
        marked.where("operator IS NOT NULL")
        .groupBy("operator")
        .agg(F.count("*").alias("n"), F.round(F.sum("sales"), 2).alias("sum_sales"))
    )


@query(on_gaps(f"SELECT {_ROW}, market FROM gaps WHERE contains(lower(market), 'ric')"))
def condition_contains(spark, folder):
    """F9"""
    return _where(gaps(spark, folder, [*ITEM_KEY, "sales", "market"]), ("market", "contains", "RIC"))


@query(on_items(f"SELECT {_ROW}, shipping_mode FROM items WHERE regexp_matches(shipping_mode, '(?i)^[12]-[a-z]+$')"))
def condition_contains_regex(spark, folder):
    """F9 with a regular expression."""
    return _where(_rows(spark, folder, "shipping_mode"), ("shipping_mode", "contains", "^[12]-[a-z]+$"), regex=True)


@query(
    on_gaps(
        f"SELECT {_ROW}, market, quantity FROM gaps "
        "WHERE market IS DISTINCT FROM 'ASIA' AND quantity >= 10 AND sales < 70000"
    )
)
def conditions_combined(spark, folder):
    """unknown columns are skipped on request."""
    table = gaps(spark, folder, [*ITEM_KEY, "sales", "market", "quantity"])
    return _where(
        table,
        ("market", "!=", "ASIA"),
        ("quantity", ">=", 10),
        ("sales", "<", 70000),
        ("warehouse", "==", "A"),
        lenient=True,
    )


@query(on_items("SELECT DISTINCT order_region FROM items ORDER BY order_region LIMIT 51"))
def pick_list_values(spark, folder):
    """At most 50 values make a pick list; one more is read to tell."""
    return predicates.sorted_distinct(order_items(spark, folder, ["order_region"]), "order_region", 51)


@query(on_items("SELECT min(sales) AS lo, max(sales) AS hi, quantile_cont(sales, 0.5) AS median FROM items"))
def picker_defaults(spark, folder):
    """F12"""
    return predicates.picker_defaults(order_items(spark, folder, ["sales"]), "sales")


# ---- keyword questions


@query(on_items(f"SELECT {_ROW}, market FROM items WHERE market = 'MIDDLE EAST'"))
def keyword_market(spark, folder):
    """F13"""
    items = _rows(spark, folder, "market")
    return keywords.ask(items, "Show me sales for the Middle East market")


@query(on_items(f"SELECT {_ROW}, customer_segment FROM items WHERE customer_segment = 'BUILDING'"))
def keyword_segment(spark, folder):
    """F14"""
    items = _rows(spark, folder, "customer_segment")
    return keywords.ask(items, "What is average sales for building segment?")


@query(on_items(f"SELECT {_ROW}, shipping_mode FROM items WHERE shipping_mode = '4-NOT SPECIFIED'"))
def keyword_shipping(spark, folder):
    """spaces do not matter, and numeric columns named like shipping are passed over."""
    items = _rows(spark, folder, "days_real", "shipping_mode").withColumnRenamed("days_real", "days_for_shipping")
    return keywords.ask(items, "Find records with 4-notspecified shipping").drop("days_for_shipping")


@query(
    on_items(
        "SELECT count(CASE WHEN hit THEN 1 END) AS matched, count(*) AS total, round(sum(CASE WHEN hit THEN sales END), 2) AS sum_sales, "
        "round(avg(CASE WHEN hit THEN sales END), 4) AS mean_sales, max(CASE WHEN hit THEN sales END) AS max_sales, "
        "min(CASE WHEN hit THEN sales END) AS min_sales "
        "FROM (SELECT sales, market = 'EUROPE' AND customer_segment = 'MACHINERY' AS hit FROM items)"
    )
)
def keyword_summary(spark, folder):
    """F16"""
    items = order_items(spark, folder, ["market", "customer_segment", "sales"])
    matches = keywords.match_question(items, "total for machinery segment in the Europe market")
    summary = keywords.query_summary(items, keywords.match_predicate(matches))
    return rounded(summary, {"sum_sales": 2, "mean_sales": 4})


# ---- profiles


@query(on_items("SELECT count(*) AS n_rows, 18 AS n_columns FROM items"))
def table_shape(spark, folder):
    """A1"""
    return profiling.table_shape(order_items(spark, folder, ["sales"]), len(ITEM_COLUMNS))


@query(
    on_gaps(
        "SELECT round(sum(sales), 2) AS sum_sales, round(avg(sales), 4) AS mean_sales, max(sales) AS max_sales, "
        "min(sales) AS min_sales FROM gaps"
    )
)
def sales_stats(spark, folder):
    """A2"""
    return rounded(profiling.target_stats(gaps(spark, folder, ["sales"])), {"sum_sales": 2, "mean_sales": 4})


@query(
    on_gaps("SELECT market, round(sum(sales), 2) AS sum_sales FROM gaps WHERE market IS NOT NULL GROUP BY market")
)
def group_totals(spark, folder):
    """A3: by the first text column with few values."""
    table = gaps(spark, folder, ["order_region", "market", "customer_segment", "sales"])
    by = profiling.small_text_columns(table)[0]
    return rounded(profiling.group_totals(table, by), {"sum_sales": 2})


@query(
    on_items(
        "SELECT order_region, count(sales) AS n_sales, round(sum(sales), 2) AS sum_sales, "
        "round(avg(sales), 2) AS mean_sales FROM items GROUP BY order_region ORDER BY order_region LIMIT 10"
    )
)
def group_stats(spark, folder):
    """A4"""
    items = order_items(spark, folder, ["order_region", "sales"])
    return rounded(profiling.group_stats(items, "order_region"), {"sum_sales": 2, "mean_sales": 2})


@query(
    on_gaps(
        "SELECT market AS value, count(*) AS n FROM gaps WHERE market IS NOT NULL GROUP BY market ORDER BY n DESC, value LIMIT 10"
    )
)
def value_counts(spark, folder):
    """A5"""
    return profiling.top_values(gaps(spark, folder, ["market"]), "market")


_COUNTED = ["market", "order_region", "quantity", "part_id"]


@query(
    on_gaps(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_distinct FROM gaps' for c in _COUNTED
        )
    )
)
def distinct_counts(spark, folder):
    """A6"""
    return profiling.distinct_counts(gaps(spark, folder, _COUNTED), _COUNTED)


@query(
    on_items(
        "SELECT order_region AS mode FROM items GROUP BY order_region ORDER BY count(*) DESC, order_region LIMIT 1"
    )
)
def most_common_region(spark, folder):
    """A7"""
    return profiling.most_common(order_items(spark, folder, ["order_region"]), "order_region")


_DESCRIBED = ["days_real", "benefit", "sales_per_customer", "quantity", "sales"]


@query(
    on_gaps(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, '
            f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
            + ", ".join(f"round(quantile_cont({c}, {q / 100}), 4) AS q{q}" for q in (25, 50, 75))
            + f", round(max({c}), 4) AS max FROM gaps"
            for c in _DESCRIBED
        )
    )
)
def describe_numeric(spark, folder):
    """A8"""
    described = profiling.describe(gaps(spark, folder, _DESCRIBED))
    return rounded(described, {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


@query(
    on_gaps(
        'SELECT * FROM ('
        + " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS n_missing, '
            f"round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 6) AS pct_missing FROM gaps"
            for c in ["market", "benefit", "sales", "quantity"]
        )
        + ") WHERE n_missing > 0"
    )
)
def missing_values(spark, folder):
    """A9"""
    report = profiling.missing_report(gaps(spark, folder, ["market", "benefit", "sales", "quantity"]))
    return rounded(report, {"pct_missing": 6})


_PROFILED = {"market": "string", "order_region": "string", "line_no": "int", "quantity": "double", "sales": "double"}


@query(
    on_gaps(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", \'{t}\' AS data_type, \'{"text" if t == "string" else "numeric"}\' AS kind, '
            f"count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct FROM gaps"
            for c, t in _PROFILED.items()
        )
    )
)
def column_profile(spark, folder):
    """A10"""
    return profiling.column_profile(gaps(spark, folder, list(_PROFILED)))


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS data_type, count({c}) AS n_filled FROM gaps" for c, t in _PROFILED.items()
)


@query(on_gaps(f"SELECT data_type, count(*) AS n_columns FROM ({_PROFILE_SQL}) GROUP BY data_type"))
def type_summary(spark, folder):
    """A10: columns per type."""
    return profiling.type_summary(profiling.column_profile(gaps(spark, folder, list(_PROFILED))))


@query(
    on_gaps(
        "SELECT count(CASE WHEN data_type <> 'string' THEN 1 END) AS n_numeric, count(CASE WHEN data_type = 'string' THEN 1 END) AS n_text "
        f"FROM ({_PROFILE_SQL})"
    )
)
def kind_counts(spark, folder):
    """A11"""
    return profiling.kind_counts(profiling.column_profile(gaps(spark, folder, list(_PROFILED))))


_PAIRS = [(a, b) for i, a in enumerate([*NUMERIC, "sales"]) for b in [*NUMERIC, "sales"][i + 1 :]]


@query(
    on_gaps(
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM gaps" for a, b in _PAIRS)
    )
)
def correlations(spark, folder):
    """Over the rows that have both values."""
    return rounded(profiling.correlations(gaps(spark, folder, [*NUMERIC, "sales"])), {"r": 8})


@query(
    on_items(
        "SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * width, 4) AS bin_lo, round(lo + (bin + 1) * width, 4) AS bin_hi, n "
        "FROM (SELECT least(floor((sales - lo) / width), 29) AS bin, any_value(lo) AS lo, any_value(width) AS width, count(*) AS n "
        "FROM items, limits GROUP BY 1)",
        "limits AS (SELECT min(sales) AS lo, (max(sales) - min(sales)) / 30.0 AS width FROM items)",
    )
)
def sales_histogram(spark, folder):
    """A13"""
    return rounded(profiling.histogram(order_items(spark, folder, ["sales"]), "sales", 30), {"bin_lo": 4, "bin_hi": 4})


@query(
    on_items(
        "SELECT round(any_value(q25), 4) AS q25, round(any_value(q50), 4) AS q50, round(any_value(q75), 4) AS q75, "
        "round(any_value(lo), 4) AS lower_fence, round(any_value(hi), 4) AS upper_fence, "
        "round(min(CASE WHEN benefit BETWEEN lo AND hi THEN benefit END), 4) AS lower_whisker, "
        "round(max(CASE WHEN benefit BETWEEN lo AND hi THEN benefit END), 4) AS upper_whisker, "
        "count(CASE WHEN benefit NOT BETWEEN lo AND hi THEN 1 END) AS n_outliers FROM items, fences",
        "quarters AS (SELECT quantile_cont(benefit, 0.25) AS q25, quantile_cont(benefit, 0.5) AS q50, "
        "quantile_cont(benefit, 0.75) AS q75 FROM items)",
        "fences AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM quarters)",
    )
)
def benefit_box(spark, folder):
    """A14"""
    box = profiling.box_summary(order_items(spark, folder, ["benefit"]), "benefit")
    return rounded(box, {c: 4 for c in box.columns if c != "n_outliers"})


@query(
    on_scored(
        " UNION ALL ".join(f"SELECT '{m}' AS model, round(avg({m}), 4) AS mean_prediction FROM scored" for m in MODELS)
    )
)
def model_means(spark, folder):
    """A15"""
    return rounded(profiling.model_means(closed_form_models(spark, folder), MODELS), {"mean_prediction": 4})


@query(
    on_scored(
        "SELECT round(sum(combined), 1) AS total_predicted, round(avg(combined), 3) AS mean_predicted, "
        "round(avg(abs(sales - combined)), 3) AS mae, round(avg(uncertainty), 3) AS mean_uncertainty FROM scored"
    )
)
def prediction_overview(spark, folder):
    """A16 with a known target."""
    scored = combine_predictions(closed_form_models(spark, folder), MODELS, "sigma")
    row = profiling.prediction_overview(scored, "combined", "sales", "uncertainty")
    return rounded(row, {"total_predicted": 1, "mean_predicted": 3, "mae": 3, "mean_uncertainty": 3})


@query(
    on_scored(
        "SELECT round(sum(m_line), 1) AS total_predicted, round(avg(m_line), 3) AS mean_predicted, "
        "round(stddev_pop(m_line), 3) AS std_predicted, round(max(m_line) - min(m_line), 3) AS prediction_range FROM scored"
    )
)
def prediction_overview_without_target(spark, folder):
    """A16 without target and uncertainty."""
    row = profiling.prediction_overview(closed_form_models(spark, folder), "m_line")
    return rounded(
        row, {"total_predicted": 1, "mean_predicted": 3, "std_predicted": 3, "prediction_range": 3}
    )


@query(
    on_gaps(
        "SELECT count(*) AS n_rows, round(avg(sales), 4) AS mean_sales, round(stddev_samp(sales), 4) AS std_sales, "
        "count(DISTINCT market) AS n_markets FROM gaps"
    )
)
def business_context(spark, folder):
    """A17"""
    row = profiling.business_context(gaps(spark, folder, ["market", "sales"]))
    return rounded(row, {"mean_sales": 4, "std_sales": 4})


@query(
    on_items(
        "SELECT count(*) AS n_rows, 18 AS n_columns, round(sum(sales), 2) AS sum_sales, round(avg(sales), 4) AS mean_sales, "
        "round(quantile_cont(sales, 0.5), 4) AS median_sales, min(sales) AS min_sales, max(sales) AS max_sales FROM items"
    )
)
def dataset_summary(spark, folder):
    """A18"""
    row = profiling.dataset_summary(order_items(spark, folder, ["sales"]), n_columns=len(ITEM_COLUMNS))
    return rounded(row, {"sum_sales": 2, "mean_sales": 4, "median_sales": 4})

