"""The flat order-item table over a star schema of parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.expressions import nan_to_null

# Output column -> (tables besides lineitem that it needs, expression).
_DEFINITIONS = {
    "type": (("part",), lambda: F.col("p_type")),
    "shipping_mode": (("orders",), lambda: F.col("o_orderpriority")),
    "customer_segment": (("customer",), lambda: F.col("c_mktsegment")),
    "market": (("region",), lambda: F.col("r_name")),
    "order_region": (("nation",), lambda: F.col("n_name")),
    "order_status": (("orders",), lambda: F.col("o_orderstatus")),
    "product_status": ((), lambda: F.col("l_linestatus")),
    "days_real": (("orders",), lambda: F.datediff("l_shipdate", "o_orderdate").cast("double")),
    "days_sched": (("orders",), lambda: F.substring("o_orderpriority", 1, 1).try_cast("int").cast("double")),
    "benefit": (
        ("part",),
        lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("p_retailprice") * F.col("l_quantity"),
    ),
    "sales_per_customer": ((), lambda: F.col("l_extendedprice") * (1 - F.col("l_discount"))),
    "quantity": ((), lambda: F.col("l_quantity")),
    "sales": ((), lambda: F.col("l_extendedprice")),
    "ts": ((), lambda: F.col("l_shipdate")),
    "order_id": ((), lambda: F.col("l_orderkey")),
    "line_no": ((), lambda: F.col("l_linenumber")),
    "part_id": ((), lambda: F.col("l_partkey")),
    "supplier_id": ((), lambda: F.col("l_suppkey")),
    # File and position of the row: tells exact copies apart when rows are put in order.
    "row_id": ((), lambda: F.xxhash64("_metadata.file_path", "_metadata.row_index")),
}

# Dimension -> (dimension it hangs on, key on that side, own key).
_LINKS = {
    "part": (None, "l_partkey", "p_partkey"),
    "orders": (None, "l_orderkey", "o_orderkey"),
    "customer": ("orders", "o_custkey", "c_custkey"),
    "nation": ("customer", "c_nationkey", "n_nationkey"),
    "region": ("nation", "n_regionkey", "r_regionkey"),
}

ITEM_COLUMNS = [name for name in _DEFINITIONS if name != "row_id"]


def order_items(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str] | None = None,
    clean_nan: bool = False,
    pick: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Order items with the asked columns, reading only the tables these columns need.

    The dimension keys are unique, so a left join neither drops nor doubles an order line;
    leaving out an unused dimension therefore changes nothing but the cost. Customers, nations
    and regions are joined to the orders first, so that the order lines are shuffled once by
    order and never by customer. A filter on a dimension column lets Catalyst turn its join
    into an inner one and reaches the dimension's scan. No join carries a broadcast hint:
    Spark broadcasts a dimension only where its size is below the session's threshold, and
    adaptive execution splits hot keys of the shuffled ones.

    ``pick`` chooses order lines before any join, as the joins keep every line: it gets them with
    the columns that need no other table and gives some of them back.
    """
    wanted = list(columns) if columns is not None else ITEM_COLUMNS
    unknown = [c for c in wanted if c not in _DEFINITIONS]
    if unknown:
        raise ValueError(f"unknown order-item columns: {unknown}")

    needed: set[str] = set()
    for name in wanted:
        for table in _DEFINITIONS[name][0]:
            while table is not None:
                needed.add(table)
                table = _LINKS[table][0]

    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    if "row_id" in wanted:
        rows = rows.withColumn("row_id", _DEFINITIONS["row_id"][1]())

    if pick is not None:
        plain = {name: make() for name, (needs, make) in _DEFINITIONS.items() if not needs and name != "row_id"}
        rows = pick(rows.withColumns(plain)).drop(*plain)

    def attach(base: DataFrame, name: str | None) -> DataFrame:
        for table, (parent, outer_key, own_key) in _LINKS.items():
            if parent == name and table in needed:
                dimension = attach(spark.read.parquet(f"{folder}/{table}.parquet"), table)
                base = base.join(dimension, F.col(outer_key) == F.col(own_key), "left")
        return base

    result = attach(rows, None).select(
        *[F.col(name) if name == "row_id" else _DEFINITIONS[name][1]().alias(name) for name in wanted]
    )
    return nan_to_null(result) if clean_nan else result
