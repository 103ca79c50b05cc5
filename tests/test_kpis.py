import datetime as dt
import random

import pytest
from conftest import day, rows

from tradewind.operators import customer, inventory, marketing, sales
from tradewind.operators.periods import Anchors

AS_OF = day("2026-09-21")
ORDERS = "order_id string, order_date date, brand string, channel string, sku_id string, quantity bigint, net_sales double"


def ago(days: int) -> dt.date:
    return AS_OF - dt.timedelta(days=days)


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [
            ("o1", ago(0), "A", "web", "s1", 2, 100.10),
            ("o1", ago(0), "A", "web", "s2", 1, 50.25),
            ("o2", ago(29), "A", "shop", "s1", 1, 30.00),
            ("o3", ago(30), "A", "web", "s1", 4, 200.00),
            ("o4", ago(59), "B", "web", "s3", 1, 80.00),
            ("o5", ago(60), "B", "web", "s3", 9, 999.00),
        ],
        ORDERS,
    )


def test_summary(orders):
    got = sales.sales_summary(orders, Anchors.single(AS_OF)).first().asDict()
    assert got == {
        "as_of": AS_OF,
        "current_net_revenue": 180.35, "current_orders": 2, "current_units_sold": 4, "current_aov": 90.18,
        "previous_net_revenue": 280.0, "previous_orders": 2, "previous_units_sold": 5, "previous_aov": 140.0,
        "pct_net_revenue": -35.6, "pct_orders": 0.0, "pct_units_sold": -20.0, "pct_aov": -35.6,
    }


def test_summary_of_an_empty_period_is_a_row_of_zeros(spark):
    empty = spark.createDataFrame([], ORDERS)
    for anchors in (Anchors.single(AS_OF), Anchors((ago(1), AS_OF))):
        got = sales.sales_summary(empty, anchors).collect()
        assert len(got) == len(anchors.dates)
        assert tuple(got[0])[1:] == (0.0, 0, 0, 0.0, 0.0, 0, 0, 0.0, None, None, None, None)


def test_segments_keep_one_sided_groups_and_order(orders):
    segments = sales.sales_by_segment(orders, Anchors.single(AS_OF), ["brand", "channel"])
    ordered = [tuple(r)[1:] for r in sales.by_largest_change(segments, ["brand", "channel"]).collect()]
    assert ordered == [
        ("B", "web", 0.0, 80.0, -80.0, -100.0),
        ("A", "web", 150.35, 200.0, -49.65, -24.8),
        ("A", "shop", 30.0, 0.0, 30.0, None),
    ]


def test_one_date_and_many_dates_agree(orders):
    many = Anchors.back_from(AS_OF, ago(120), 30)
    for columns in (["brand", "channel"], ["sku_id", "brand"], ["channel"]):
        history = sales.sales_by_segment(orders, many, columns)
        for as_of in (AS_OF, ago(1), ago(31), ago(61)):
            one = sales.sales_by_segment(orders, Anchors.single(as_of), columns)
            assert rows(one) == rows(history.filter(history.as_of == as_of))
    history = sales.sales_summary(orders, many)
    one = sales.sales_summary(orders, Anchors.single(ago(31)))
    assert rows(one) == rows(history.filter(history.as_of == ago(31)))


def test_marketing_uses_ratio_of_sums(spark):
    frame = spark.createDataFrame(
        [
            (ago(0), "K", "social", 10.0, 5.0), (ago(1), "K", "social", 30.0, 5.0),
            (ago(30), "K", "social", 10.0, 20.0), (ago(0), "K", "search", 0.0, 7.0), (ago(40), "L", "search", 5.0, 0.0),
        ],
        "date date, brand string, marketing_channel string, spend double, attributed_revenue double",
    )
    got = marketing.by_worst_roas(marketing.marketing_by_segment(frame, Anchors.single(AS_OF))).collect()
    assert [tuple(r)[1:] for r in got] == [
        ("K", "social", 40.0, 10.0, 0.25, 10.0, 20.0, 2.0, -87.5),
        ("K", "search", 0.0, 7.0, 0.0, 0.0, 0.0, 0.0, None),
        ("L", "search", 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, None),
    ]


def test_cac_keeps_channels_with_one_side(spark):
    spend = spark.createDataFrame(
        [(ago(0), "search", 30.0), (ago(29), "social", 10.0), (ago(30), "search", 99.0)],
        "date date, marketing_channel string, spend double",
    )
    people = spark.createDataFrame(
        [("1", "search", ago(0)), ("2", "search", ago(29)), ("3", "search", ago(5)), ("4", "referral", ago(1)),
         ("5", "social", ago(30))],
        "customer_id string, acquisition_channel string, first_order_date date",
    )
    want = [(AS_OF, "referral", 0.0, 1, 0.0), (AS_OF, "search", 30.0, 3, 10.0), (AS_OF, "social", 10.0, 0, None)]
    assert rows(marketing.cac_by_channel(spend, people, Anchors.single(AS_OF))) == want
    many = marketing.cac_by_channel(spend, people, Anchors((ago(3), AS_OF)))
    assert rows(many.filter(many.as_of == AS_OF)) == want


def test_mix_rounds_shares_and_is_null_for_an_empty_period(spark):
    frame = spark.createDataFrame(
        [(ago(0), True), (ago(1), False), (ago(2), False)], "order_date date, is_new_customer boolean"
    )
    assert rows(customer.customer_mix(frame, Anchors.single(AS_OF))) == [(AS_OF, 0.333, None, 0.667, None)]


def test_first_order_marks_the_customer_as_new(spark):
    heads = spark.createDataFrame(
        [(3, ago(2), "c", 5.0), (2, ago(2), "c", 6.0), (1, ago(1), "c", 7.0), (9, ago(0), "d", 1.0)],
        "order_id bigint, order_date date, customer_id string, net_sales double",
    )
    flags = {r.order_id: r.is_new_customer for r in customer.flag_new_customers(heads).collect()}
    assert flags == {1: False, 2: True, 3: False, 9: True}
    channels = spark.createDataFrame([("c", "search")], "customer_id string, acquisition_channel string")
    summary = customer.customer_summary(heads, channels)
    assert rows(summary) == [("c", "search", ago(2), 3, 18.0, True), ("d", None, ago(0), 1, 1.0, False)]
    assert customer.repeat_purchase_rate(summary).first()[0] == 0.5
    assert customer.repeat_purchase_rate(summary.limit(0)).first()[0] is None


STOCK = "date date, sku_id string, brand string, units_sold bigint, closing_stock bigint"


def test_risk_rounds_step_by_step(spark):
    stock = spark.createDataFrame(
        [
            (ago(0), "fast", "A", 5, 10), (ago(1), "fast", "A", 2, 15), (ago(20), "fast", "A", 100, 50),
            (ago(0), "idle", "A", 0, 4), (ago(0), "gone", "A", 0, 0), (ago(1), "absent", "A", 3, 3),
            (ago(0), "slow", "B", 1, 61),
        ],
        STOCK,
    )
    got = inventory.by_shortest_cover(inventory.inventory_risk(stock, Anchors.single(AS_OF))).collect()
    assert [tuple(r)[1:] for r in got] == [
        ("gone", "A", 0, 0.0, None, False, False),
        ("idle", "A", 4, 0.0, None, False, True),
        ("fast", "A", 10, 3.5, 2.9, True, False),
        ("slow", "B", 61, 1.0, 61.0, False, True),
    ]
    counted = inventory.flag_counts(inventory.inventory_risk(stock, Anchors.single(AS_OF)))
    assert tuple(counted.first()) == (AS_OF, 3, 4)
    again = inventory.reflag(inventory.inventory_risk(stock, Anchors.single(AS_OF)), 2.0, 100.0)
    assert [(r.sku_id, r.stockout_risk, r.excess_risk) for r in inventory.flagged(again).collect()] == [("idle", False, True)]


def test_risk_matches_brute_force_with_duplicate_rows(spark):
    pick = random.Random(5)
    data = [(ago(pick.randrange(40)), pick.choice("xyz"), "A", pick.randrange(9), pick.randrange(50)) for _ in range(150)]
    data += data[:20] + [data[0]] * 70
    frame = spark.createDataFrame(data, STOCK).repartition(3)
    anchors = Anchors.back_from(AS_OF, ago(60), 30)
    want = []
    for as_of in anchors.dates:
        for d, sku, brand, _, closing in data:
            if d == as_of:
                sold = [u for e, s, _, u, _ in data if s == sku and 0 <= (as_of - e).days < 14]
                want.append((as_of, sku, brand, closing, sum(sold) / len(sold)))
    got = inventory.inventory_risk(frame, anchors).collect()
    simple = sorted((r.as_of, r.sku_id, r.brand, r.on_hand) for r in got)
    assert simple == sorted(w[:4] for w in want)
    means = {(w[0], w[1]): w[4] for w in want}
    assert all(abs(r.velocity - means[r.as_of, r.sku_id]) <= 0.005 + 1e-9 for r in got)
    velocity = {(r.as_of, r.sku_id): r.velocity for r in inventory.sku_velocity(frame, anchors).collect()}
    assert all(velocity[r.as_of, r.sku_id] == r.velocity for r in got)
