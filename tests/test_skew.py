"""One key holds a third of all rows: results stay whole and right, and what
reaches a single task is bounded by days or by a fixed number."""

import datetime as dt

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from tradewind.operators import customer, ledger, sales
from tradewind.operators.periods import Anchors

START, DAYS, ROWS = day("2026-01-01"), 90, 90_000
LAST = START + dt.timedelta(days=DAYS - 1)


@pytest.fixture(scope="module")
def lines(spark):
    return (
        spark.range(ROWS, numPartitions=6)
        .withColumn("hot", F.col("id") % 3 == 0)
        .select(
            F.col("id").alias("order_id"),
            F.expr(f"date_add(date'{START}', cast(hash(id) & 1048575 as int) % {DAYS})").alias("order_date"),
            F.when(F.col("hot"), "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("brand"),
            F.when(F.col("hot"), "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 501)).alias("sku_id"),
            F.when(F.col("hot"), "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 4001)).alias("customer_id"),
            (F.col("id") % 5 + 1).alias("quantity"),
            ((F.col("id") % 997) / 100).alias("net_sales"),
        )
    )


def test_segments_over_many_dates(spark, lines):
    anchors = Anchors.back_from(LAST, START, 14)
    got = sales.sales_by_segment(lines, anchors, ["brand"])
    lines.createOrReplaceTempView("skewed_lines")
    anchors.frame(spark).createOrReplaceTempView("skewed_anchors")
    want = spark.sql(
        """SELECT as_of, brand,
             sum(if(order_date >= current_start, bigint(rint(net_sales * 100)), 0L)) / 100D AS current_net_revenue,
             sum(if(order_date < current_start, bigint(rint(net_sales * 100)), 0L)) / 100D AS previous_net_revenue
           FROM skewed_lines JOIN skewed_anchors ON order_date BETWEEN previous_start AND as_of GROUP BY ALL"""
    )
    columns = ["as_of", "brand", "current_net_revenue", "previous_net_revenue"]
    assert rows(got.select(*columns)) == rows(want.select(*columns))
    assert got.filter("brand = 'hot'").count() == len(anchors.dates)


def test_the_busy_customer_has_one_first_order(lines):
    flagged = customer.flag_new_customers(lines)
    assert flagged.count() == ROWS
    firsts = flagged.filter("is_new_customer").groupBy("customer_id").count()
    assert firsts.count() == lines.select("customer_id").distinct().count()
    assert firsts.agg(F.max("count")).first()[0] == 1
    hot = lines.filter("customer_id = 'hot'").orderBy("order_date", "order_id").first()
    assert flagged.filter("is_new_customer and customer_id = 'hot'").first()["order_id"] == hot["order_id"]


def test_the_busy_sku_is_a_row_per_day_in_the_ledger(spark, lines):
    units = ledger.units_by_sku_day(lines)
    skus = lines.select("sku_id", F.lit("B").alias("brand"), F.lit(5).cast("bigint").alias("opening0")).distinct()
    start = LAST - dt.timedelta(days=DAYS - 1)
    grid = ledger.daily_stock(ledger.stock_moves(units, skus, start, LAST), start, LAST)
    assert rows(grid.groupBy("sku_id").count().select("count").distinct()) == [(DAYS,)]
    assert grid.agg(F.sum("demand")).first()[0] == lines.agg(F.sum("quantity")).first()[0]
