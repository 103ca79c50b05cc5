"""Demand, replenishment and the stock ledger per SKU and day.

Days on which nothing moves have no row until a dense table is asked for. Windows
are partitioned by SKU, hold a row per day of the calendar at most, and go by block of days and day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import discounted

# Comparison windows and replenishment policy.
RECENT_DAYS = 30
BASELINE_DAYS = 30
REVIEW_INTERVAL_DAYS = 7
FALLBACK_DAILY_DEMAND = 0.5
UNIT_COST_FRACTION = 0.45
# Days of a block, and with that the most rows of a SKU in it.
BLOCK_DAYS = 128


def is_recent(day: Column, end: dt.date) -> Column:
    """The last 30 days up to and including `end`."""
    return day.between(F.lit(end - dt.timedelta(days=RECENT_DAYS - 1)), F.lit(end))


def is_baseline(day: Column, end: dt.date) -> Column:
    """The 30 days before the recent ones."""
    last = end - dt.timedelta(days=RECENT_DAYS)
    return day.between(F.lit(last - dt.timedelta(days=BASELINE_DAYS - 1)), F.lit(last))


def units_by_sku_day(orders: DataFrame, day: str = "order_date") -> DataFrame:
    return orders.groupBy("sku_id", F.col(day).alias("date")).agg(
        F.sum(F.col("quantity").cast("bigint")).alias("units")
    )


def daily_rate(baseline_units: Column) -> Column:
    """Baseline units per calendar day; a fixed rate where there were none."""
    return F.coalesce(baseline_units.cast("double") / F.lit(float(BASELINE_DAYS)), F.lit(FALLBACK_DAILY_DEMAND))


def baseline_daily_demand(units: DataFrame, skus: DataFrame, end: dt.date) -> DataFrame:
    """Mean units per calendar day of the baseline window, for every SKU."""
    totals = (
        units.filter(is_baseline(F.col("date"), end)).groupBy("sku_id").agg(F.sum("units").alias("_units"))
    )
    return skus.select("sku_id").join(totals, "sku_id", "left").select(
        "sku_id", daily_rate(F.col("_units")).alias("daily_demand")
    )


def day_count(start: dt.date, end: dt.date) -> int:
    return (end - start).days + 1


def first_receipt(daily_demand: Column) -> Column:
    """The order on the first day covers a week at the baseline rate."""
    return F.bround(daily_demand * F.lit(float(REVIEW_INTERVAL_DAYS)), 0).cast("bigint")


def movements(units: DataFrame, skus: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Days on which stock of a SKU may move, from `start` to `end`: ``sku_id``,
    ``block``, ``day`` (days since `start`), ``demand``, ``receipts``, and on the
    first day ``opening0``.

    Only days with demand, the review days after them and the first day
    have a row, whatever the length of the range. Receipts do not
    depend on the stock level: every seventh day the demand of the seven days
    before is reordered. SKUs that `skus` does not list are left out. A day of a SKU
    may have several rows in `units`, as order lines do.
    """
    return _all_movements(units, skus, start, end).join(skus.select("sku_id"), "sku_id", "left_semi")


def _all_movements(units: DataFrame, skus: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """`movements`, and those of SKUs that aren't listed."""
    n = day_count(start, end)
    nothing = F.lit(0).cast("bigint")
    unknown = F.lit(None).cast("bigint")

    # Dealt by SKU alone, and before a sale is counted on several days: the groups
    # and windows below, all within a SKU, need no further exchange.
    sold = units.filter(F.col("date").between(F.lit(start), F.lit(end))).select(
        "sku_id", F.datediff("date", F.lit(start)).alias("_at"), F.col("units").cast("bigint").alias("_units")
    )
    dealt = sold.unionByName(skus.select("sku_id", "opening0", F.lit(1).alias("_listed")), allowMissingColumns=True).repartition("sku_id")
    days = dealt.groupBy("sku_id", "_at").agg(
        F.sum("_units").alias("_units"), F.max("opening0").alias("opening0"), F.max("_listed").alias("_listed")
    )
    at, asked = F.col("_at"), F.col("_units")

    def part(day: Column, demand: Column, receipts: Column, baseline: Column) -> Column:
        return F.struct(day.alias("day"), demand.alias("demand"), receipts.alias("receipts"), baseline.alias("baseline"))

    # A sale counts on its day, on the review day after its week, and where it is
    # part of the baseline on the first day, as the opening stock does.
    review = (F.floor(at / F.lit(REVIEW_INTERVAL_DAYS)) + 1).cast("int") * REVIEW_INTERVAL_DAYS
    in_baseline = is_baseline(F.date_add(F.lit(start), at), end)
    placed = days.select(
        "sku_id",
        "opening0",
        "_listed",
        F.inline(
            F.array(
                part(at, asked, nothing, unknown),
                part(review, nothing, asked, unknown),
                part(F.lit(0), nothing, nothing, F.when(in_baseline, asked)),
            )
        ),
    ).filter(
        (F.col("day") < n)
        & ((F.col("demand") > 0) | (F.col("receipts") > 0) | F.col("baseline").isNotNull() | F.col("_listed").isNotNull())
    )
    block = F.floor(F.col("day") / F.lit(BLOCK_DAYS)).cast("int")
    first = F.when(F.col("day") == 0, first_receipt(daily_rate(F.sum("baseline")))).otherwise(nothing)
    return placed.groupBy("sku_id", block.alias("block"), "day").agg(
        F.sum("demand").alias("demand"), (F.sum("receipts") + first).alias("receipts"), F.max("opening0").alias("opening0")
    )


def floored_scan(moves: DataFrame, key: str, block: str, order: str, change: str, initial: str) -> DataFrame:
    """Adds ``before`` and ``after``: a level that starts at `initial` (given on a
    key's first row) and moves by `change`, but never below zero.

    With D the running sum and L the lowest D so far, the level is D + max(initial, -L): two
    running windows over one sort, by `block` and `order`, and no join. A window
    holds the rows of a key, of which a ledger has one per day of the calendar at most.
    """
    rows = _in_order(key, block, order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    summed = moves.withColumns(
        {"_sum": F.sum(change).over(so_far), "_start": F.first(initial, ignorenulls=True).over(so_far)}
    )
    within = summed.withColumns({"_low": F.min("_sum").over(so_far), "_low_before": F.min("_sum").over(earlier)})
    # `greatest` skips the NULL before the first row of a key.
    return within.select(
        *moves.columns,
        (F.col("_sum") - F.col(change) + F.greatest("_start", -F.col("_low_before"))).alias("before"),
        (F.col("_sum") + F.greatest("_start", -F.col("_low"))).alias("after"),
    )


def _in_order(key: str, block: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(block, order)


def stock_moves(units: DataFrame, skus: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The stock ledger on the days of `movements`: ``date``, ``sku_id``, ``brand``,
    ``opening_stock``, ``receipts``, ``units_sold``, ``closing_stock``, and ``demand``, ``block``, ``day``, ``until_day``
    (the day before the SKU's next row).

    Stock never goes below zero and unmet demand is lost. Between two rows of a
    SKU nothing moves, and opening and closing equal the closing before.
    """
    # The windows leave rows in the order of SKUs that the join needs; it also leaves out those that aren't listed.
    moves = _all_movements(units, skus, start, end).withColumns(
        {"_change": F.col("receipts") - F.col("demand"), "until_day": _last_day(start, end)}
    )
    level = floored_scan(moves, "sku_id", "block", "day", "_change", "opening0")
    return level.join(skus.select("sku_id", "brand"), "sku_id").select(
        F.date_add(F.lit(start), F.col("day")).alias("date"),
        "sku_id",
        "brand",
        F.col("before").alias("opening_stock"),
        "receipts",
        (F.col("before") + F.col("receipts") - F.col("after")).alias("units_sold"),
        F.col("after").alias("closing_stock"),
        "demand",
        "block",
        "day",
        "until_day",
    )


def moving_days(moves: DataFrame) -> DataFrame:
    """Without rows on which nothing moves, except for the first day."""
    return moves.filter((F.col("receipts") > 0) | (F.col("demand") > 0) | (F.col("day") == 0))


LEDGER_COLUMNS = ("date", "sku_id", "brand", "opening_stock", "receipts", "units_sold", "closing_stock")


def _last_day(start: dt.date, end: dt.date) -> Column:
    """The day before the next row of the SKU, or the last."""
    return F.lead("day", 1, day_count(start, end)).over(_in_order("sku_id", "block", "day")) - 1


def stock_spans(moves: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The ledger with ``until``: the last day to which a row's closing stock stands and nothing moves."""
    until = F.date_add(F.lit(start), F.col("until_day"))
    return moves.withColumn("until", until).select(*LEDGER_COLUMNS, "until")


def daily_stock(moves: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The ledger and ``demand`` of every SKU on every day: each row fills the days
    up to the next one of its SKU, on which nothing moves."""
    filled = moves.withColumn("_at", F.explode(F.sequence("day", "until_day")))
    moving = F.col("_at") == F.col("day")
    nothing = F.lit(0).cast("bigint")
    return filled.select(
        F.date_add(F.lit(start), F.col("_at")).alias("date"),
        "sku_id",
        "brand",
        F.when(moving, F.col("opening_stock")).otherwise(F.col("closing_stock")).alias("opening_stock"),
        *(F.when(moving, F.col(c)).otherwise(nothing).alias(c) for c in ("receipts", "units_sold")),
        "closing_stock",
        F.when(moving, F.col("demand")).otherwise(nothing).alias("demand"),
    )


def replenishment(units: DataFrame, skus: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every SKU on every day: ``sku_id``, ``date``, ``day_index``, ``trailing_demand`` (of the
    seven days before) and ``receipts``.

    Demand enters the trailing days on the day after and leaves them a week later;
    each of these days fills those up to the next one. A window holds the days of a SKU.
    """
    n = day_count(start, end)
    nothing = F.lit(0).cast("bigint")

    def change(shift: int, trailing: Column, receipts: Column) -> Column:
        return F.struct(
            (F.col("day") + shift).alias("day"), trailing.alias("_trailing"), receipts.alias("receipts")
        )

    changes = F.array(
        change(0, nothing, F.col("receipts")),
        change(1, F.col("demand"), nothing),
        change(1 + REVIEW_INTERVAL_DAYS, -F.col("demand"), nothing),
    )
    steps = (
        _all_movements(units, skus, start, end)
        .select("sku_id", F.inline(changes))
        .filter((F.col("day") < n) & ((F.col("day") == 0) | (F.col("_trailing") != 0) | (F.col("receipts") > 0)))
        .groupBy("sku_id", "day")
        .agg(F.sum("_trailing").alias("_trailing"), F.sum("receipts").alias("receipts"))
    )
    days = Window.partitionBy("sku_id").orderBy("day")
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    filled = steps.select(
        "sku_id", "day", "receipts",
        F.sum("_trailing").over(so_far).alias("trailing_demand"),
        (F.lead("day", 1, n).over(days) - 1).alias("_until"),
    )
    # The window leaves rows in the order of SKUs that the join needs.
    filled = filled.join(skus.select("sku_id"), "sku_id", "left_semi").withColumn("_at", F.explode(F.sequence("day", "_until")))
    return filled.select(
        "sku_id",
        F.date_add(F.lit(start), F.col("_at")).alias("date"),
        F.col("_at").alias("day_index"),
        "trailing_demand",
        F.when(F.col("_at") == F.col("day"), F.col("receipts")).otherwise(nothing).alias("receipts"),
    )


def price_orders(orders: DataFrame, skus: DataFrame) -> DataFrame:
    """Selling price from list price and discount, net sales from price and
    quantity; the price is in whole cents, halves away from zero."""
    price = discounted(F.col("base_price"), F.col("discount"))
    return (
        orders.join(skus.select("sku_id", "base_price"), "sku_id")
        .withColumn("selling_price", price.cast("double"))
        .withColumn("net_sales", (price * F.col("quantity").cast("bigint")).cast("double"))
    )


def unit_cost(base_price: Column) -> Column:
    """45 % of the list price, rounded to whole cents."""
    return F.round(base_price.cast("decimal(18,6)") * F.lit(UNIT_COST_FRACTION).cast("decimal(3,2)"), 2).cast("double")
