"""Sales KPIs: net revenue, orders, units, average order value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import amount, dollars, pct_change, ratio
from .periods import Anchors, distinct_totals, period_totals


def sales_summary(orders: DataFrame, anchors: Anchors) -> DataFrame:
    """One row per as-of date: both periods and percent changes.

    Revenue and units are summed per day; an order counts once in each period,
    also where its lines have several dates.
    """
    daily = (
        orders.filter(anchors.covers(F.col("order_date")))
        .groupBy("order_date")
        .agg(
            F.expr(f"coalesce(sum({amount('net_sales')}), 0)").alias("net"),
            F.coalesce(F.sum(F.col("quantity").cast("bigint")), F.lit(0).cast("bigint")).alias("units"),
        )
    )
    counted = distinct_totals(orders, anchors, "order_date", "order_id", name="orders")
    totals = period_totals(daily, anchors, "order_date", [], {m: m for m in ("net", "units")})
    # Both have one row per as-of date, which fills the other's columns.
    both = totals.unionByName(counted, allowMissingColumns=True)
    totals = both.groupBy("as_of").agg(*(F.max(c).alias(c) for c in both.columns if c != "as_of"))

    def aov(side: str):
        per_order = ratio(dollars(F.col(f"{side}_net"), 2), F.col(f"{side}_orders"))
        return F.coalesce(F.round(per_order, 2), F.lit(0.0)).alias(f"{side}_aov")

    named = totals.select(
        "as_of",
        *(
            column
            for side in ("current", "previous")
            for column in (
                dollars(F.col(f"{side}_net"), 2).alias(f"{side}_net_revenue"),
                F.col(f"{side}_orders"),
                F.col(f"{side}_units").alias(f"{side}_units_sold"),
                aov(side),
            )
        ),
    )
    return named.withColumns(
        {
            f"pct_{kpi}": pct_change(F.col(f"current_{kpi}"), F.col(f"previous_{kpi}"))
            for kpi in ("net_revenue", "orders", "units_sold", "aov")
        }
    )


def sales_by_segment(orders: DataFrame, anchors: Anchors, group_cols: Sequence[str]) -> DataFrame:
    """Net revenue per segment: both periods, change and percent change."""
    totals = period_totals(orders, anchors, "order_date", group_cols, {"net": amount("net_sales")})
    current, previous = F.col("current_net"), F.col("previous_net")
    return totals.select(
        "as_of",
        *group_cols,
        dollars(current).alias("current_net_revenue"),
        dollars(previous).alias("previous_net_revenue"),
        dollars(current - previous).alias("change"),
        pct_change(current, previous).alias("pct_change"),
    )


def by_largest_change(segments: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Report order: largest swings first."""
    return segments.orderBy("as_of", *by_change(group_cols))


def by_change(group_cols: Sequence[str]) -> list[Column]:
    return [F.abs("change").desc(), *(F.asc(c) for c in group_cols)]
