"""Checks on tables and KPIs that report what is wrong, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Days whose rows `duplicate_days` counts side by side.
SPAN_DAYS = 32


def violations(name: str, table: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule, all rules in one pass over the table. A rule that
    is NULL for a row counts as violated; ``no_nulls`` is always added."""
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in table.columns))
    checked = {"no_nulls": complete, **rules}
    counted = table.agg(
        *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in checked.items())
    )
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in checked))
    return counted.select(F.lit(name).alias("table"), F.inline(pairs))


def duplicate_days(name: str, table: DataFrame, key: str, day: str) -> DataFrame:
    """`duplicate_keys` of a table that has `key` on most days: its rows are counted per day in one
    row for each SPAN_DAYS days of a key, which is all that a shuffle sees of them."""
    # Rows without a day are one key, in a span of their own.
    at, span = F.coalesce(F.pmod(F.unix_date(day), F.lit(SPAN_DAYS)), F.lit(0)), F.floor(F.unix_date(day) / F.lit(SPAN_DAYS))
    spans = table.groupBy(key, span.alias("_span")).agg(*(F.count_if(at == i).alias(f"_{i}") for i in range(SPAN_DAYS)))
    repeated = reduce(lambda a, b: a + b, ((F.col(f"_{i}") > 1).cast("long") for i in range(SPAN_DAYS)))
    found = spans.agg(F.coalesce(F.sum(repeated), F.lit(0).cast("long")).alias("violations"))
    return found.select(F.lit(name).alias("table"), F.lit("unique_key").alias("rule"), "violations")


def duplicate_keys(name: str, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    repeated = table.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("violations"))
    return repeated.select(F.lit(name).alias("table"), F.lit("unique_key").alias("rule"), "violations")


def table_invariants(
    orders: DataFrame, marketing: DataFrame, inventory: DataFrame, customers: DataFrame, skus: DataFrame,
    order_key: Sequence[str] = ("order_id",),
) -> DataFrame:
    c = F.col
    checks = [
        violations("orders", orders, {"quantity_positive": c("quantity") > 0, "net_sales_not_negative": c("net_sales") >= 0}),
        duplicate_keys("orders", orders, order_key),
        violations(
            "marketing",
            marketing,
            {"spend_positive": c("spend") > 0, "impressions_cover_clicks": c("impressions") >= c("clicks")},
        ),
        violations(
            "inventory",
            inventory,
            {
                "stock_not_negative": (c("opening_stock") >= 0) & (c("closing_stock") >= 0),
                "stock_balances": c("closing_stock") == c("opening_stock") + c("receipts") - c("units_sold"),
            },
        ),
        duplicate_days("inventory", inventory, "sku_id", "date"),
        violations("customers", customers, {"has_orders": c("total_orders") > 0}),
        duplicate_keys("customers", customers, ["customer_id"]),
        violations("skus", skus, {"price_above_cost": c("base_price") > c("unit_cost")}),
        duplicate_keys("skus", skus, ["sku_id"]),
    ]
    return reduce(DataFrame.unionByName, checks)


# Margins a designated row must reach, and limits every other
# row of sufficient size must stay within.
DESIGNATED_SALES_MAX_PCT = -40.0
DESIGNATED_ROAS_MAX_PCT = -45.0
DESIGNATED_NEW_SHARE_MAX_PCT = -55.0
DESIGNATED_COVER_MAX_DAYS = 2.5
OTHER_SALES_MIN_PCT = -35.0
OTHER_ROAS_MIN_PCT = -40.0
OTHER_COVER_MIN_DAYS = 3.0
MIN_SALES_BASE = 500.0
MIN_MARKETING_SPEND = 1000.0


def _expect(
    rows: DataFrame, check: str, subject: Column, value: Column, designated: Column, reached: Column, safe: Column
) -> DataFrame:
    """Designated rows that miss their margin, other rows beyond the limit."""
    held = F.when(designated, F.coalesce(value.isNotNull() & reached, F.lit(False))).otherwise(
        F.coalesce(safe, F.lit(True))
    )
    return rows.filter(~held).select(
        "as_of",
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        designated.alias("designated"),
        value.cast("double").alias("value"),
    )


def expectation_failures(
    sales_segments: DataFrame,
    marketing_segments: DataFrame,
    mix: DataFrame,
    risk: DataFrame,
    sales_segment: tuple[str, str],
    marketing_segment: tuple[str, str],
    sku: object,
) -> DataFrame:
    """Reasons the designated issues do not stand out clearly; empty if they
    do and nothing else crosses the high limits."""
    c = F.col
    mix_change = F.try_divide(c("current_new_share") - c("previous_new_share"), c("previous_new_share")) * 100
    checks = [
        _expect(
            sales_segments.filter(c("previous_net_revenue") >= MIN_SALES_BASE),
            "sales_decline",
            F.concat_ws(" / ", "brand", "channel"),
            c("pct_change"),
            (c("brand") == sales_segment[0]) & (c("channel") == sales_segment[1]),
            c("pct_change") <= DESIGNATED_SALES_MAX_PCT,
            c("pct_change") > OTHER_SALES_MIN_PCT,
        ),
        _expect(
            marketing_segments.filter(c("previous_spend") >= MIN_MARKETING_SPEND),
            "roas_decline",
            F.concat_ws(" / ", "brand", "marketing_channel"),
            c("roas_change_pct"),
            (c("brand") == marketing_segment[0]) & (c("marketing_channel") == marketing_segment[1]),
            c("roas_change_pct") <= DESIGNATED_ROAS_MAX_PCT,
            c("roas_change_pct") > OTHER_ROAS_MIN_PCT,
        ),
        _expect(
            mix,
            "new_share_drop",
            F.lit("all"),
            F.round(mix_change, 1),
            F.lit(True),
            mix_change <= DESIGNATED_NEW_SHARE_MAX_PCT,
            F.lit(True),
        ),
        _expect(
            risk,
            "stockout",
            c("sku_id"),
            c("days_of_cover"),
            c("sku_id") == F.lit(sku),
            c("days_of_cover") < DESIGNATED_COVER_MAX_DAYS,
            c("days_of_cover") >= OTHER_COVER_MIN_DAYS,
        ),
    ]
    return reduce(DataFrame.unionByName, checks)
