"""Registry of the checked queries and the pieces that they share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.expressions import nan_to_null
from orderlens.session import small_side
from orderlens.sources.order_items import order_items


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL twin where SQL can express it."""

    def register(run):
        REGISTRY[name or run.__name__] = Query(run, sql)
        return run

    return register


ITEM_ORDER_SQL = "ts, order_id, line_no, part_id, supplier_id, quantity, sales"

_ITEMS = """items AS (
  SELECT p_type AS type, o_orderpriority AS shipping_mode, c_mktsegment AS customer_segment,
         r_name AS market, n_name AS order_region, o_orderstatus AS order_status,
         l_linestatus AS product_status,
         CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS days_real,
         CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS days_sched,
         l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS benefit,
         l_extendedprice * (1 - l_discount) AS sales_per_customer,
         l_quantity AS quantity, l_extendedprice AS sales, l_shipdate AS ts,
         l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""

_GAPS = """gaps AS (
  SELECT * REPLACE (
    CASE WHEN order_status <> 'P' THEN market END AS market,
    CASE WHEN quantity <> 13 THEN sales END AS sales,
    CASE WHEN days_sched <> 3 THEN benefit END AS benefit)
  FROM items
)"""

_SCORED = """lines AS (
  SELECT regr_slope(sales, sales_per_customer) AS s1, regr_intercept(sales, sales_per_customer) AS i1,
         regr_slope(sales, quantity) AS s2, regr_intercept(sales, quantity) AS i2
  FROM items
), by_quantity AS (
  SELECT quantity AS q, avg(sales) AS m_group, stddev_samp(sales) AS sigma FROM items GROUP BY quantity
), models AS (
  SELECT items.*, m_group, s1 * sales_per_customer + i1 AS m_line, s2 * quantity + i2 AS m_quantity, sigma
  FROM items JOIN by_quantity ON quantity = q CROSS JOIN lines
), scored AS (
  SELECT *, combined - 1.96 * uncertainty AS lower, combined + 1.96 * uncertainty AS upper FROM (
    SELECT *, greatest(spread, sigma) AS uncertainty FROM (
      SELECT *, sqrt(((m_group - combined) * (m_group - combined) + (m_line - combined) * (m_line - combined)
                      + (m_quantity - combined) * (m_quantity - combined)) / 3.0) AS spread
      FROM (SELECT *, (m_group + m_line + m_quantity) / 3.0 AS combined FROM models)))
)"""


def on_items(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([_ITEMS, *more]) + "\n" + body


def on_gaps(body: str, *more: str) -> str:
    return on_items(body, _GAPS, *more)


def on_scored(body: str, *more: str) -> str:
    return on_items(body, _SCORED, *more)


def md5_bucket(columns: Sequence[str], buckets: int, seed: int) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in columns]])
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % {buckets} AS INTEGER)"


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round floating results, whose last digits depend on the order of additions."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def gaps(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """Order items with missing values put in by rule: NULL markets and sales, NaN benefits."""
    needs = {"market": "order_status", "sales": "quantity", "benefit": "days_sched"}
    wanted = list(dict.fromkeys([*columns, *[needs[c] for c in columns if c in needs]]))
    items = order_items(spark, folder, wanted)
    changes = {
        "market": F.when(F.col("order_status") != "P", F.col("market")) if "market" in wanted else None,
        "sales": F.when(F.col("quantity") != 13, F.col("sales")) if "sales" in wanted else None,
        "benefit": F.when(F.col("days_sched") != 3, F.col("benefit")).otherwise(F.lit(float("nan")))
        if "benefit" in wanted
        else None,
    }
    return nan_to_null(items.withColumns({c: v for c, v in changes.items() if v is not None}).select(*columns))


MODELS = ["m_group", "m_line", "m_quantity"]


def closed_form_models(spark: SparkSession, folder: str, columns: Sequence[str] = ()) -> DataFrame:
    """Three predictors that SQL can state as well: a group mean and two fitted lines, with a sigma per group."""
    wanted = list(dict.fromkeys([*columns, "quantity", "sales_per_customer", "sales"]))
    items = order_items(spark, folder, wanted)
    lines = items.agg(
        F.struct(
            F.regr_slope("sales", "sales_per_customer").alias("s1"),
            F.regr_intercept("sales", "sales_per_customer").alias("i1"),
            F.regr_slope("sales", "quantity").alias("s2"),
            F.regr_intercept("sales", "quantity").alias("i2"),
        ).alias("lines")
    ).scalar()
    groups = items.groupBy(F.col("quantity").alias("q")).agg(
        F.avg("sales").alias("m_group"), F.stddev_samp("sales").alias("sigma")
    )
    # few rows, so that the order lines stay where they are; their size is checked, not estimated
    return items.join(small_side(groups), F.col("quantity") == F.col("q")).select(
        *wanted,
        "m_group",
        (lines["s1"] * F.col("sales_per_customer") + lines["i1"]).alias("m_line"),
        (lines["s2"] * F.col("quantity") + lines["i2"]).alias("m_quantity"),
        "sigma",
    )
