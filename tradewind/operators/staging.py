"""Cleaning of the raw tables: trim dimensions, keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio

# Fixed value: every kind of blank that surrounds a dimension value.
BLANKS = " \t\n\r\f\v"


def trimmed(column: str) -> Column:
    return F.btrim(F.col(column), F.lit(BLANKS)).alias(column)


def trim_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.withColumns({c: trimmed(c) for c in columns})


def dedupe_first(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per `keys` by `order`, remaining columns breaking ties.

    ``row_number() = 1`` is planned as a group limit ahead of the shuffle:
    each map task sends at most one row per key, so a key that holds a large
    part of all rows costs no more than any other. Ties beyond `order` are
    broken by every other column, which makes the choice reproducible.
    """
    ties = [c for c in frame.columns if c not in keys and c not in order]
    window = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in [*order, *ties]))
    return (
        frame.withColumn("_position", F.row_number().over(window))
        .filter(F.col("_position") == 1)
        .drop("_position")
    )


def stage_orders(orders: DataFrame, keys: Sequence[str] = ("order_id",)) -> DataFrame:
    """Trim brand and channel, keep the earliest row per order.

    Where the date is a function of the order, add ``order_date`` to `keys`:
    the result is the same and date filters then move below the dedupe.
    """
    order = [] if "order_date" in keys else ["order_date"]
    return trim_columns(dedupe_first(orders, keys, order), ["brand", "channel"])


def stage_customers(customers: DataFrame) -> DataFrame:
    return trim_columns(dedupe_first(customers, ["customer_id"], ["first_order_date"]), ["acquisition_channel"])


def stage_skus(skus: DataFrame) -> DataFrame:
    return trim_columns(dedupe_first(skus, ["sku_id"], []), ["brand"])


def stage_marketing(marketing: DataFrame) -> DataFrame:
    """Trim and add the row-level ROAS, NULL where nothing was spent."""
    staged = trim_columns(marketing, ["brand", "marketing_channel"])
    return staged.withColumn("roas", ratio(F.col("attributed_revenue"), F.col("spend")))


def stage_inventory(inventory: DataFrame) -> DataFrame:
    """Trim only: the stock table is not deduplicated."""
    return trim_columns(inventory, ["brand"])
