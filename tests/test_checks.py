from conftest import day, rows
from pyspark.sql import functions as F

from tradewind.operators import compare, quality

KPI = "k string, pct_change double, current_net_revenue double, stockout_risk boolean"


def test_tolerance_is_one_rounding_step(spark):
    def differing(a, b):
        left = spark.createDataFrame([("x", *a)], KPI)
        right = spark.createDataFrame([("x", *b)], KPI)
        return sorted(r.column for r in compare.differences(left, right, ["k"]).collect())

    assert differing((-42.3, 100.0, True), (-42.2, 100.0000001, True)) == []
    assert differing((-42.3, 100.0, True), (-42.5, 100.5, False)) == ["current_net_revenue", "pct_change", "stockout_risk"]
    assert differing((None, None, None), (None, None, None)) == []
    assert differing((None, 1.0, True), (0.0, None, None)) == ["current_net_revenue", "pct_change", "stockout_risk"]


def test_rows_on_one_side_are_reported_once(spark):
    left = spark.createDataFrame([("a", 1.0, 1.0, True), ("b", 1.0, 1.0, True)], KPI)
    right = spark.createDataFrame([("b", 1.0, 1.0, True), ("c", 1.0, 1.0, True)], KPI)
    got = compare.differences(left, right, ["k"])
    assert rows(got) == [("a", "(row)", "present", None), ("c", "(row)", None, "present")]
    assert tuple(compare.agreement(left, right, ["k"]).first()) == (2, 2, 0)
    assert tuple(compare.agreement(left, left, ["k"]).first()) == (2, 0, 0)


def test_items_are_compared_fact_by_fact(spark):
    schema = (
        "as_of date, lens string, issue_type string, kpi_to_monitor string, severity string, headline string, "
        "possible_action string, likely_drivers array<string>, supporting_kpi map<string,double>, affected map<string,string>"
    )

    def items(*data):
        return spark.createDataFrame(
            [(day("2026-09-21"), "s", "t", k, sev, "h", "p", [drv], kpi, {"brand": drv} if k == "e" else {}) for k, sev, drv, kpi in data], schema
        )

    left = items(("a", "high", "x", {"pct_change": -42.3, "impact": None}), ("b", "low", "x", {"n": 1.0}), ("c", "low", "x", {}), ("e", "low", "x", {}))
    right = items(("a", "high", "y", {"pct_change": -42.2, "impact": None}), ("b", "high", "x", {"n": 1.1}), ("d", "low", "x", {}), ("e", "low", "y", {}))
    got = compare.item_differences(left, right).select("kpi_to_monitor", "column", "a", "b")
    assert rows(got) == [
        ("b", "n", "1.0", "1.1"), ("b", "severity", "low", "high"), ("c", "(row)", "low", None), ("d", "(row)", None, "low"),
        ("e", "affected.brand", "x", "y"),
    ]
    assert tuple(compare.item_agreement(left, left).first()) == (4, 0, 0)


def test_violations_count_missing_values_and_broken_rules(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 0), (None, 5), ("b", None)], "k string, n int")
    got = quality.violations("t", frame, {"positive": F.col("n") > 0})
    assert rows(got) == [("t", "no_nulls", 2), ("t", "positive", 2)]
    assert rows(quality.duplicate_keys("t", frame, ["k"])) == [("t", "unique_key", 1)]


def test_expectations(spark):
    d = day("2026-09-21")
    sales = spark.createDataFrame(
        [(d, "M", "r", 1000.0, -45.0), (d, "M", "w", 1000.0, -36.0), (d, "A", "w", 400.0, -90.0), (d, "A", "n", 900.0, None)],
        "as_of date, brand string, channel string, previous_net_revenue double, pct_change double",
    )
    spend = spark.createDataFrame(
        [(d, "K", "s", 1000.0, -44.9), (d, "K", "t", 1000.0, -39.9)],
        "as_of date, brand string, marketing_channel string, previous_spend double, roas_change_pct double",
    )
    mix = spark.createDataFrame([(d, 0.2, 0.5)], "as_of date, current_new_share double, previous_new_share double")
    risk = spark.createDataFrame([(d, "s1", 2.0), (d, "s2", 2.9), (d, "s3", None)], "as_of date, sku_id string, days_of_cover double")
    got = quality.expectation_failures(sales, spend, mix, risk, ("M", "r"), ("K", "s"), "s1")
    assert rows(got.drop("as_of")) == [
        ("roas_decline", "K / s", True, -44.9),
        ("sales_decline", "M / w", False, -36.0),
        ("stockout", "s2", False, 2.9),
    ]
    weak = quality.expectation_failures(sales, spend, mix.withColumn("previous_new_share", F.lit(0.0)), risk, ("M", "r"), ("K", "t"), "s3")
    assert {("new_share_drop", None), ("stockout", None)} <= {(r.check, r.value) for r in weak.collect()}
