"""Customer KPIs: new-customer share, repeat rate, per-customer summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import amount, dollars, ratio
from .periods import Anchors, period_totals
from .staging import dedupe_first


def customer_mix(orders: DataFrame, anchors: Anchors) -> DataFrame:
    """Share of orders placed by new customers, both periods; NULL where a
    period has no orders."""
    totals = period_totals(
        orders,
        anchors,
        "order_date",
        [],
        {"new": "bigint(is_new_customer)", "orders": "1L"},
    )
    shares = totals.select(
        "as_of",
        *(
            F.round(ratio(F.col(f"{s}_new"), F.col(f"{s}_orders")), 3).alias(f"{s}_new_share")
            for s in ("current", "previous")
        ),
    )
    return shares.withColumns(
        {f"{s}_returning_share": F.round(1 - F.col(f"{s}_new_share"), 3) for s in ("current", "previous")}
    )


def repeat_purchase_rate(customers: DataFrame) -> DataFrame:
    """Share of customers with more than one order, over all data whatever
    the as-of date; NULL without customers."""
    return customers.agg(F.round(F.avg(F.col("is_returning").cast("int")), 3).alias("repeat_purchase_rate"))


def flag_new_customers(orders: DataFrame) -> DataFrame:
    """Adds ``is_new_customer``: the order is its customer's first one.

    First orders are found per customer and matched back by order id, so one
    customer with a large part of all orders does not gather in one task.
    """
    first = dedupe_first(
        orders.select("customer_id", "order_date", "order_id"), ["customer_id"], ["order_date", "order_id"]
    ).select("order_id", F.lit(True).alias("_first"))
    return (
        orders.join(first, "order_id", "left")
        .withColumn("is_new_customer", F.coalesce("_first", F.lit(False)))
        .drop("_first")
    )


def customer_summary(orders: DataFrame, acquisition: DataFrame) -> DataFrame:
    """Per customer: first order day, order count, total and the channel the
    customer came through (NULL if unknown)."""
    per_customer = orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.count("order_id").alias("total_orders"),
        dollars(F.expr(f"sum({amount('net_sales')})"), 2).alias("total_net_sales"),
    )
    return per_customer.join(acquisition.select("customer_id", "acquisition_channel"), "customer_id", "left").select(
        "customer_id",
        "acquisition_channel",
        "first_order_date",
        "total_orders",
        "total_net_sales",
        (F.col("total_orders") > 1).alias("is_returning"),
    )
