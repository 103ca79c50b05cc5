"""Marketing KPIs: spend, ROAS and acquisition cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import amount, dollars, pct_change, ratio
from .periods import Anchors, period_totals

SEGMENT = ("brand", "marketing_channel")


def marketing_by_segment(marketing: DataFrame, anchors: Anchors) -> DataFrame:
    """Spend, attributed revenue and ROAS per brand and marketing channel.

    ROAS is the ratio of the period's sums; 0 where nothing was spent.
    """
    totals = period_totals(
        marketing,
        anchors,
        "date",
        SEGMENT,
        {"spend": amount("spend"), "revenue": amount("attributed_revenue")},
    )
    columns = ["as_of", *SEGMENT]
    for side in ("current", "previous"):
        spend, revenue = F.col(f"{side}_spend"), F.col(f"{side}_revenue")
        columns += [
            dollars(spend).alias(f"{side}_spend"),
            dollars(revenue).alias(f"{side}_attributed_revenue"),
            F.coalesce(ratio(dollars(revenue), dollars(spend)), F.lit(0.0)).alias(f"{side}_roas"),
        ]
    return totals.select(*columns).withColumn(
        "roas_change_pct", pct_change(F.col("current_roas"), F.col("previous_roas"))
    )


def cac_by_channel(marketing: DataFrame, customers: DataFrame, anchors: Anchors) -> DataFrame:
    """Current-period spend per newly acquired customer and channel.

    A channel may have only spend or only customers; the other side is 0.
    """
    spend = period_totals(
        marketing, anchors, "date", ["marketing_channel"], {"spend": amount("spend")}, previous=False
    )
    acquired = period_totals(
        customers.withColumnRenamed("acquisition_channel", "marketing_channel"),
        anchors,
        "first_order_date",
        ["marketing_channel"],
        {"customers": "1L"},
        previous=False,
    )
    joined = spend.join(acquired, ["as_of", "marketing_channel"], "full")
    spent = F.coalesce(dollars(F.col("current_spend")), F.lit(0.0))
    count = F.coalesce("current_customers", F.lit(0).cast("bigint"))
    return joined.select(
        "as_of",
        "marketing_channel",
        spent.alias("spend"),
        count.alias("new_customers"),
        F.round(ratio(spent, count), 2).alias("cac"),
    )


def by_worst_roas(segments: DataFrame) -> DataFrame:
    """Report order: steepest decline first, not computable last."""
    return segments.orderBy("as_of", *by_roas_change())


def by_roas_change() -> list[Column]:
    return [F.col("roas_change_pct").asc_nulls_last(), *(F.asc(c) for c in SEGMENT)]
