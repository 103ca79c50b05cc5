import datetime as dt
import random

import pytest
from conftest import day, in_order, rows
from pyspark.sql import functions as F

from tradewind.operators import inventory, ledger
from tradewind.operators.periods import Anchors
from tradewind.sources import star_schema

END = day("2026-09-21")


def ago(days: int) -> dt.date:
    return END - dt.timedelta(days=days)


def _units(spark, data):
    return spark.createDataFrame(data, "sku_id string, date date, units bigint")


def _skus(spark, data):
    return spark.createDataFrame(data, "sku_id string, brand string, opening0 bigint")


def test_windows(spark):
    frame = spark.createDataFrame([(a, ago(a)) for a in (-1, 0, 29, 30, 59, 60)], "age int, d date")
    got = frame.select("age", ledger.is_recent(F.col("d"), END).alias("r"), ledger.is_baseline(F.col("d"), END).alias("b"))
    assert {(r.age, r.r, r.b) for r in got.collect()} == {
        (-1, False, False), (0, True, False), (29, True, False), (30, False, True), (59, False, True), (60, False, False),
    }


def test_baseline_rate_per_calendar_day(spark):
    units = _units(spark, [("a", ago(30), 20), ("a", ago(59), 10), ("a", ago(29), 99), ("b", ago(0), 5)])
    skus = _skus(spark, [("a", "A", 0), ("b", "B", 0)])
    assert rows(ledger.baseline_daily_demand(units, skus, END)) == [("a", 1.0), ("b", 0.5)]


def test_ledger_equals_a_plain_loop(spark):
    """Over several blocks, with stock that runs out and never does."""
    pick = random.Random(3)
    days = 400
    demand = {}
    for sku in ("a", "b", "c"):
        for age in range(0, 450):
            if pick.random() < 0.5:
                demand[sku, ago(age)] = pick.randrange(1, 9)
    demand["unlisted", ago(3)] = 4
    opening = {"a": 3, "b": 40, "c": 0, "never": 11}
    units = _units(spark, [(s, d, n) for (s, d), n in demand.items()])
    skus = _skus(spark, [(s, s.upper(), n) for s, n in opening.items()])
    start = ago(days - 1)
    moves = ledger.stock_moves(units, skus, start, END)
    got = ledger.daily_stock(moves, start, END).select(*ledger.LEDGER_COLUMNS).select(
        "date", "sku_id", "brand", "opening_stock", "receipts", "units_sold", "closing_stock"
    )
    assert got.count() == days * len(opening)

    want = []
    for sku, stock in opening.items():
        base = sum(n for (s, d), n in demand.items() if s == sku and ago(59) <= d <= ago(30))
        rate = base / 30 if base else 0.5
        raw = []
        for i in range(days):
            today = start + dt.timedelta(days=i)
            asked = demand.get((sku, today), 0)
            receipts = 0
            if i == 0:
                receipts = round(rate * 7)
            elif i % 7 == 0:
                receipts = sum(raw[-7:])
            sold = min(asked, stock + receipts)
            want.append((today, sku, sku.upper(), stock, receipts, sold, stock + receipts - sold))
            stock = stock + receipts - sold
            raw.append(asked)
    assert rows(got) == in_order(want)
    assert any(w[6] == 0 for w in want)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_floored_scan_at_any_block_size(spark, block):
    pick = random.Random(block)
    changes = {key: [pick.randrange(-9, 9) for _ in range(60)] for key in "abc"}
    starts = {"a": 0, "b": 25, "c": 3}
    data = [(k, i // block, i, d, starts[k] if i == 0 else None) for k, run in changes.items() for i, d in enumerate(run)]
    moves = spark.createDataFrame(data, "key string, block int, day int, change bigint, start bigint")
    got = ledger.floored_scan(moves, "key", "block", "day", "change", "start").select("key", "day", "before", "after")
    want = []
    for key, run in changes.items():
        level = starts[key]
        for i, d in enumerate(run):
            want.append((key, i, level, max(0, level + d)))
            level = max(0, level + d)
    assert rows(got) == in_order(want)


def test_no_ledger_window_holds_more_than_a_block(spark):
    units = _units(spark, [("a", ago(3), 2)])
    skus = _skus(spark, [("a", "A", 5)])
    moves = ledger.stock_moves(units, skus, ago(2000), END)
    text = ledger.daily_stock(moves, ago(2000), END)._jdf.queryExecution().analyzed().toString()
    for line in text.splitlines():
        if "windowspecdefinition(sku_id" in line:
            assert "block" in line.split("windowspecdefinition(", 1)[1].split(" ASC")[0]
    per_block = moves.groupBy("sku_id", "block").count().agg(F.max("count")).first()[0]
    assert per_block <= ledger.BLOCK_DAYS


def test_positions_from_spans_equal_those_from_days(spark):
    pick = random.Random(9)
    units = _units(spark, [(s, ago(a), pick.randrange(1, 6)) for s in "abc" for a in range(300) if pick.random() < 0.1])
    skus = _skus(spark, [("a", "A", 3), ("b", "B", 90), ("c", "B", 0), ("d", "D", 7)])
    start = ago(250)
    moves = ledger.stock_moves(units, skus, start, END)
    daily, spans = ledger.daily_stock(moves, start, END), ledger.stock_spans(moves, start, END)
    for dates in (Anchors.single(END), Anchors.back_from(END, start, 7, 5), Anchors((start, ago(100), ago(3), END + dt.timedelta(2)))):
        want = rows(inventory.inventory_risk(daily, dates, 14))
        assert want and rows(inventory.inventory_risk(spans, dates, 14)) == want


def test_units_and_prices(spark):
    orders = spark.createDataFrame(
        [("s", END, 2, 0.15), ("s", END, 3, 0.0)], "sku_id string, order_date date, quantity bigint, discount double"
    )
    assert rows(ledger.units_by_sku_day(orders)) == [("s", END, 5)]
    skus = spark.createDataFrame([("s", 19.99)], "sku_id string, base_price double")
    priced = ledger.price_orders(orders, skus).select("selling_price", "net_sales")
    assert rows(priced) == [(16.99, 33.98), (19.99, 59.97)]
    assert skus.select(ledger.unit_cost(F.col("base_price"))).first()[0] == 9.0


def test_the_loaded_stock_table_is_whole_but_stored_as_runs(spark, tmp_path, monkeypatch):
    """A NULL brand, a SKU without sales, sales on one day twice: every SKU on every day comes back."""
    start = day("2026-01-01")
    lines = [(1, 1, 1, 1.0, 9.0, 0.0, "N", 3), (1, 1, 2, 2.0, 9.0, 0.0, "N", 3), (2, 2, 1, 400.0, 9.0, 0.0, "R", 40), (3, None, 1, 5.0, 9.0, 0.0, "N", 60)]
    spark.createDataFrame(
        [(*row[:7], dt.datetime.combine(start, dt.time()) + dt.timedelta(days=row[7])) for row in lines],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_returnflag string, l_shipdate timestamp_ntz",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, " B1 ", 3, 10.0), (2, None, 4, 20.0), (3, "B3", None, 30.0)], "p_partkey long, p_brand string, p_size int, p_retailprice double"
    ).write.parquet(f"{tmp_path}/part.parquet")
    span = star_schema.Clock(start, start, start, start + dt.timedelta(days=99), start, start)
    written = []

    def counted(frame):
        written.append(frame.count())
        return materialize(frame)

    materialize = star_schema.materialize
    monkeypatch.setattr(star_schema, "materialize", counted)
    loaded = star_schema.loaded_inventory(spark, str(tmp_path), span)
    want = star_schema.inventory(spark, str(tmp_path), span)
    assert loaded.columns == want.columns and loaded.count() == 3 * 100
    assert rows(loaded) == rows(want)
    assert len(written) == 1 and written[0] < 20
