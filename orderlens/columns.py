"""Names of the order-item table."""

from __future__ import annotations

# The canonical column names and the spellings accepted for each,
# in the order in which they are tried.
SPELLINGS = {
    "type": ["Type", "type"],
    "shipping_mode": ["Shipping Mode", "Shipping_Mode", "shipping_mode"],
    "customer_segment": ["Customer Segment", "Customer_Segment", "customer_segment"],
    "market": ["Market", "market"],
    "order_region": ["Order Region", "Order_Region", "order_region"],
    "order_status": ["Order Status", "Order_Status", "order_status"],
    "product_status": ["Product Status", "Product_Status", "product_status"],
    "days_real": ["Days for shipping (real)", "days_real"],
    "days_sched": ["Days for shipment (scheduled)", "days_sched"],
    "benefit": ["Benefit per order", "benefit"],
    "sales_per_customer": ["Sales per customer", "sales_per_customer"],
    "quantity": ["Order Item Quantity", "quantity"],
    "sales": ["Sales", "sales"],
}

CATEGORICAL = [
    "type",
    "shipping_mode",
    "customer_segment",
    "market",
    "order_region",
    "order_status",
    "product_status",
]
NUMERIC = ["days_real", "days_sched", "benefit", "sales_per_customer", "quantity"]
TARGET = "sales"
FEATURES = CATEGORICAL + NUMERIC

# Categorical columns that are offered as filters.
FILTER_COLUMNS = ["market", "customer_segment", "shipping_mode", "order_region", "type"]

# Total order of the order items: time first, then the keys of the row.
ITEM_KEY = ["order_id", "line_no", "part_id", "supplier_id"]
ITEM_ORDER = ["ts", *ITEM_KEY, "quantity", "sales"]
