from conftest import day, rows

from tradewind.operators import staging


def test_trim_takes_every_kind_of_blank_and_leaves_ids(spark):
    frame = spark.createDataFrame([(" 1 ", "\t A b\n ")], "order_id string, brand string")
    assert rows(staging.trim_columns(frame, ["brand"])) == [(" 1 ", "A b")]


def test_orders_keep_the_earliest_row(spark):
    frame = spark.createDataFrame(
        [("a", day("2026-01-02"), " X", "web", 1.0), ("a", day("2026-01-01"), "X ", "shop", 2.0),
         ("b", day("2026-01-03"), "Y", "web", 3.0)],
        "order_id string, order_date date, brand string, channel string, net_sales double",
    )
    assert rows(staging.stage_orders(frame)) == [
        ("a", day("2026-01-01"), "X", "shop", 2.0),
        ("b", day("2026-01-03"), "Y", "web", 3.0),
    ]


def test_ties_are_broken_the_same_way_whatever_the_row_order(spark):
    data = [("a", day("2026-01-01"), n, s) for n in (3, 1, 2) for s in ("z", "x")]
    for partitions in (1, 5):
        frame = spark.createDataFrame(data, "k string, d date, n int, s string").repartition(partitions)
        assert rows(staging.dedupe_first(frame, ["k"], ["d"])) == [("a", day("2026-01-01"), 1, "x")]
        data.reverse()


def test_a_hot_key_is_cut_down_before_the_shuffle(spark):
    hot = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', string(id)) k", "id")
    plan = staging.dedupe_first(hot, ["k"], ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert plan.count() == 20_001
    assert plan.filter("k = 'hot'").first()["id"] == 0


def test_marketing_roas_is_null_without_spend(spark):
    frame = spark.createDataFrame(
        [("A ", " s", 4.0, 10.0), ("A", "s", 0.0, 10.0)],
        "brand string, marketing_channel string, spend double, attributed_revenue double",
    )
    assert rows(staging.stage_marketing(frame)) == [("A", "s", 0.0, 10.0, None), ("A", "s", 4.0, 10.0, 2.5)]


def test_skus_and_customers_keep_one_row_and_inventory_all(spark):
    skus = spark.createDataFrame([("s", "B "), ("s", "B "), ("t", "C")], "sku_id string, brand string")
    assert rows(staging.stage_skus(skus)) == [("s", "B"), ("t", "C")]
    customers = spark.createDataFrame(
        [("c", " web", day("2026-02-01")), ("c", "shop ", day("2026-01-01"))],
        "customer_id string, acquisition_channel string, first_order_date date",
    )
    assert rows(staging.stage_customers(customers)) == [("c", "shop", day("2026-01-01"))]
    stock = spark.createDataFrame([("s", " B"), ("s", " B")], "sku_id string, brand string")
    assert rows(staging.stage_inventory(stock)) == [("s", "B"), ("s", "B")]
