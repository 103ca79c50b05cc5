"""Declared schemas. Nothing is inferred; every column is required."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "BOOL": T.BooleanType(),
    "INT64": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "DATE": T.DateType(),
}


def schema(**columns: str) -> T.StructType:
    """StructType from ``name="TYPE"`` pairs, in the given order."""
    return T.StructType([T.StructField(name, _TYPES[kind], nullable=False) for name, kind in columns.items()])


# The five core tables.
ORDERS = schema(
    order_id="STRING",
    order_date="DATE",
    brand="STRING",
    channel="STRING",
    sku_id="STRING",
    customer_id="STRING",
    is_new_customer="BOOL",
    quantity="INT64",
    selling_price="FLOAT64",
    discount="FLOAT64",
    net_sales="FLOAT64",
)
MARKETING = schema(
    date="DATE",
    brand="STRING",
    marketing_channel="STRING",
    spend="FLOAT64",
    impressions="INT64",
    clicks="INT64",
    attributed_orders="INT64",
    attributed_revenue="FLOAT64",
)
INVENTORY = schema(
    date="DATE",
    sku_id="STRING",
    brand="STRING",
    opening_stock="INT64",
    receipts="INT64",
    units_sold="INT64",
    closing_stock="INT64",
)
CUSTOMERS = schema(
    customer_id="STRING",
    acquisition_channel="STRING",
    first_order_date="DATE",
    total_orders="INT64",
    total_net_sales="FLOAT64",
    is_returning="BOOL",
)
SKUS = schema(sku_id="STRING", brand="STRING", base_price="FLOAT64", unit_cost="FLOAT64")

CORE_TABLES = {
    "orders": ORDERS,
    "marketing": MARKETING,
    "inventory": INVENTORY,
    "customers": CUSTOMERS,
    "skus": SKUS,
}
