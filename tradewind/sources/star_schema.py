"""The commerce tables built from a star schema of order lines and events.

Three source clocks differ: orders, shipments and events start and end on
different days, which `clock` reads from the data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import discounted
from ..operators import ledger
from ..operators.customer import customer_summary, flag_new_customers
from ..operators.periods import Anchors
from ..operators.rejects import Parent, sorted_out
from ..operators.staging import dedupe_first, stage_inventory, stage_marketing, stage_skus, trim_columns
from .storage import materialize

# Names of the marketing channels; the fourth has no spend.
MARKETING_CHANNELS = ("paid_search", "paid_social", "affiliate", "referral")

OPENING_STOCK_PER_SIZE = 5

# Duplicate lines are resolved by these columns, in this order.
LINE_ORDER = ("ship_date", "sku_id", "extended_price", "quantity", "discount", "returned")


# Columns of the source tables that are read. Declared, so no
# file is opened to plan a query.
SOURCE_COLUMNS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "part": "p_partkey BIGINT, p_brand STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_COLUMNS[name]).parquet(f"{path}/{name}.parquet")


@dataclass(frozen=True)
class Clock:
    """First and last day of each source."""

    first_order: dt.date
    last_order: dt.date
    first_ship: dt.date
    last_ship: dt.date
    first_event: dt.date
    last_event: dt.date

    @property
    def shipping_lag(self) -> int:
        return (self.last_ship - self.last_order).days

    @property
    def event_shift(self) -> int:
        """Days by which events run ahead of orders."""
        return (self.last_event - self.last_order).days


def clock(spark: SparkSession, path: str) -> Clock:
    """The days the data spans; the driver reads one row per source."""
    dated = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    bounds = [
        table(spark, path, name).agg(F.min(F.to_date(day)).alias("first"), F.max(F.to_date(day)).alias("last")).withColumn("name", F.lit(name))
        for name, day in dated.items()
    ]
    found = {r["name"]: (r["first"], r["last"]) for r in reduce(DataFrame.unionByName, bounds).collect()}
    empty = [name for name in dated if found[name][0] is None]
    if empty:
        raise ValueError(f"no dated rows in {empty}: cannot choose as-of dates")
    return Clock(*(day for name in dated for day in found[name]))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Order lines as delivered: a line may be present more than once."""
    return table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_extendedprice").alias("extended_price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )


def order_headers(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").alias("net_sales"),
    )


def shipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Staged lines without their order header."""
    return dedupe_first(raw_lines(spark, path), ["order_id", "line_no"], LINE_ORDER)


def net_sales(extended_price: Column, discount: Column) -> Column:
    """Price less discount in whole cents, halves away from zero."""
    return discounted(extended_price, discount).cast("double")


def joined_lines(spark: SparkSession, path: str) -> DataFrame:
    """Delivered lines with the date, customer and channel of their order."""
    return raw_lines(spark, path).join(order_headers(spark, path).drop("net_sales"), "order_id")


def order_lines(spark: SparkSession, path: str) -> DataFrame:
    """The staged orders table at line grain.

    The order date depends on the order id, so it joins the dedupe keys: a
    period filter then passes the dedupe and reaches the order scan, and the
    shuffle on the order id serves the join, the dedupe and distinct counts.
    """
    lines = dedupe_first(joined_lines(spark, path), ["order_id", "line_no", "order_date"], LINE_ORDER)
    return trim_columns(lines.join(sku_brands(spark, path), "sku_id"), ["brand", "channel"]).withColumn(
        "net_sales", net_sales(F.col("extended_price"), F.col("discount"))
    )


def sorted_lines(spark: SparkSession, path: str, delivered: DataFrame | None = None) -> DataFrame:
    """Delivered lines (the raw ones) with what becomes of each; `rejects.kept` of it are the staged lines."""
    malformed = {
        "no ship date": F.col("ship_date").isNotNull(),
        "quantity": F.col("quantity") >= 0,
        "price": F.col("extended_price") >= 0,
        "discount": F.col("discount").between(0, 1),
    }
    parents = [
        Parent("no order", order_headers(spark, path), "order_id"),
        Parent("no sku", sku_brands(spark, path), "sku_id"),
    ]
    rows = raw_lines(spark, path) if delivered is None else delivered
    return sorted_out(rows, ["order_id", "line_no"], LINE_ORDER, malformed, parents)


def sku_brands(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "part").select(F.col("p_partkey").alias("sku_id"), F.col("p_brand").alias("brand"))


def raw_skus(spark: SparkSession, path: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, path, "part").select(
        F.col("p_partkey").alias("sku_id"),
        F.col("p_brand").alias("brand"),
        price.alias("base_price"),
        ledger.unit_cost(price).alias("unit_cost"),
        (F.col("p_size") * OPENING_STOCK_PER_SIZE).cast("bigint").alias("opening0"),
    )


def skus(spark: SparkSession, path: str) -> DataFrame:
    return stage_skus(raw_skus(spark, path))


def orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders at order grain with the new-customer flag."""
    return flag_new_customers(order_headers(spark, path))


def acquisition(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("acquisition_channel")
    )


def customers(spark: SparkSession, path: str) -> DataFrame:
    return customer_summary(order_headers(spark, path), acquisition(spark, path))


def _event_day(shift: int) -> Column:
    return F.date_sub(F.to_date("ts"), shift)


def _bucket() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _channel(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in MARKETING_CHANNELS]), (index + 1).cast("int"))


def raw_marketing(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    """Daily spend and response per brand and channel, from the event stream;
    event days are moved back by `shift`."""
    kind = F.col("event_type")

    def amount(event: str) -> Column:
        paid = F.sum(F.when(kind == event, F.col("value").cast("decimal(18,6)")))
        return F.coalesce(paid.cast("double"), F.lit(0.0))

    return (
        table(spark, path, "events")
        .groupBy(
            _event_day(shift).alias("date"),
            F.concat(F.lit("B"), (_bucket() % 5).cast("string")).alias("brand"),
            _channel(F.col("user_id") % 3).alias("marketing_channel"),
        )
        .agg(
            amount("click").alias("spend"),
            F.count_if(kind == "view").alias("impressions"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "purchase").alias("attributed_orders"),
            amount("purchase").alias("attributed_revenue"),
        )
    )


def marketing(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    return stage_marketing(raw_marketing(spark, path, shift))


def acquired_customers(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    """First sign-up per user, with the channel it came through."""
    signups = (
        table(spark, path, "events")
        .filter(F.col("event_type") == "signup")
        .select(F.col("user_id").alias("customer_id"), "ts", "event_id", "props")
    )
    return dedupe_first(signups, ["customer_id"], ["ts", "event_id"]).select(
        "customer_id",
        _channel(_bucket() % 4).alias("acquisition_channel"),
        _event_day(shift).alias("first_order_date"),
    )


def units(spark: SparkSession, path: str) -> DataFrame:
    return ledger.units_by_sku_day(shipped_lines(spark, path), "ship_date")


def sold_lines(spark: SparkSession, path: str) -> DataFrame:
    """Staged lines as the ledger takes them: a SKU may have several rows a day. Of the columns
    that resolve duplicate lines, those after the quantity can't change these."""
    asked = LINE_ORDER[: LINE_ORDER.index("quantity") + 1]
    lines = dedupe_first(raw_lines(spark, path).select("order_id", "line_no", *asked), ["order_id", "line_no"], asked)
    return lines.select("sku_id", F.col("ship_date").alias("date"), F.col("quantity").alias("units"))


def stock_moves(spark: SparkSession, path: str, span: Clock, end: dt.date | None = None) -> DataFrame:
    """The ledger from the first shipment to `end` (the last one), on days on which stock may move."""
    plan = stage_skus(raw_skus(spark, path)).select("sku_id", "brand", "opening0")
    return ledger.stock_moves(sold_lines(spark, path), plan, span.first_ship, end or span.last_ship)


def inventory(spark: SparkSession, path: str, span: Clock, end: dt.date | None = None) -> DataFrame:
    """The stock table: every SKU on every day from the first shipment to `end`."""
    end = end or span.last_ship
    return _every_day(stock_moves(spark, path, span, end), span, end)


def loaded_inventory(spark: SparkSession, path: str, span: Clock, end: dt.date | None = None) -> DataFrame:
    """`inventory`, written and read back. The days after a row on which nothing moves are stored with
    it as a run, and filled in where the table is read: the file grows with the sales, not with the calendar."""
    end = end or span.last_ship
    return _every_day(materialize(stock_moves(spark, path, span, end).drop("block")), span, end)


def _every_day(moves: DataFrame, span: Clock, end: dt.date) -> DataFrame:
    daily = ledger.daily_stock(moves, span.first_ship, end)
    return stage_inventory(daily.select(*ledger.LEDGER_COLUMNS))


def stock_spans(spark: SparkSession, path: str, span: Clock, end: dt.date | None = None) -> DataFrame:
    """The stock table with a row only where stock moves."""
    end = end or span.last_ship
    return stage_inventory(ledger.stock_spans(stock_moves(spark, path, span, end), span.first_ship, end))


def commerce_tables(
    spark: SparkSession, path: str, anchors: Anchors, span: Clock, store: bool = False, store_stock: bool = False
) -> dict[str, DataFrame]:
    """All tables on the order clock, for runs that combine lenses.

    With `store` the staged lines of the periods in question are written once
    to the shared folder, because several KPI sections start from them; with `store_stock` the
    stock table is too, for runs that compute positions more than once.
    """
    staged = (
        order_lines(spark, path)
        .filter(anchors.covers(F.col("order_date")))
        .select("order_id", "order_date", "brand", "channel", "sku_id", "quantity", "net_sales")
    )
    stock = stock_spans(spark, path, span, span.last_order)
    if store_stock:
        stock = materialize(stock.select("date", "sku_id", "brand", "units_sold", "closing_stock", "until"))
    return {
        "orders": materialize(staged) if store else staged,
        "order_heads": orders(spark, path),
        "marketing": marketing(spark, path, span.event_shift),
        "acquired": acquired_customers(spark, path, span.event_shift),
        "customers": customers(spark, path),
        "inventory": stock,
    }


def line_returns(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of every staged line, and how many of them came back."""
    lines = shipped_lines(spark, path).join(sku_brands(spark, path), "sku_id")
    back = F.when(F.col("returned"), F.col("quantity")).otherwise(F.lit(0).cast("bigint"))
    return trim_columns(lines, ["brand"]).select(
        "ship_date", "brand", F.col("quantity").alias("pieces"), back.alias("pieces_back")
    )
