from conftest import day, rows

from tradewind.operators import rules
from tradewind.plans import lens as L

AS_OF = day("2026-09-21")


def defaults(name, **changed):
    return rules.literals({**L.load_lens(name).defaults(), **changed})


RISK = "as_of date, sku_id string, brand string, on_hand bigint, velocity double, days_of_cover double"


def test_stockout_and_its_recovery(spark):
    low = spark.createDataFrame([(AS_OF, "AUR-003", "Aurora", 10, 3.5, 2.9)], RISK)
    item = rules.detect_inventory_issues(low, defaults("inventory")).first()
    assert (item.issue_type, item.severity, item.kpi_to_monitor) == ("stockout_risk", "high", "days_of_cover[AUR-003]")
    assert item.supporting_kpi == {
        "on_hand": 10.0, "velocity_per_day": 3.5, "days_of_cover": 2.9, "estimated_revenue_impact": None,
    }
    assert item.affected == {"brand": "Aurora", "sku_id": "AUR-003"}
    assert item.likely_drivers == [
        "Demand of ~3.5 units/day against on-hand stock of 10 leaves ~2.9 days of cover."
    ]
    refilled = spark.createDataFrame([(AS_OF, "AUR-003", "Aurora", 120, 3.5, 34.3)], RISK)
    assert rules.detect_inventory_issues(refilled, defaults("inventory")).count() == 0


def test_cover_limits_are_strict_and_stockout_hides_excess(spark):
    frame = spark.createDataFrame(
        [
            (AS_OF, "a", "A", 7, 1.0, 7.0), (AS_OF, "b", "A", 6, 1.0, 6.9), (AS_OF, "c", "A", 3, 1.0, 3.0),
            (AS_OF, "d", "A", 60, 1.0, 60.0), (AS_OF, "e", "A", 61, 1.0, 60.1), (AS_OF, "f", "A", 5, 0.0, None),
            (AS_OF, "g", "A", 0, 0.0, None),
        ],
        RISK,
    )
    got = {r.affected["sku_id"]: (r.issue_type, r.severity) for r in rules.detect_inventory_issues(frame, defaults("inventory")).collect()}
    assert got == {
        "b": ("stockout_risk", "medium"), "c": ("stockout_risk", "medium"),
        "e": ("excess_inventory_risk", "low"), "f": ("excess_inventory_risk", "low"),
    }
    both = rules.detect_inventory_issues(frame, defaults("inventory", stockout_days=100.0, excess_days=1.0)).collect()
    assert {r.issue_type for r in both if r.affected["sku_id"] == "e"} == {"stockout_risk"}


MARKETING = (
    "as_of date, brand string, marketing_channel string, current_spend double, current_attributed_revenue double, "
    "current_roas double, previous_spend double, previous_attributed_revenue double, previous_roas double, "
    "roas_change_pct double"
)


def test_marketing_decline_and_its_recovery(spark):
    worse = spark.createDataFrame(
        [(AS_OF, "Kestrel", "paid_social", 5000.0, 4000.0, 0.8, 2000.0, 6000.0, 3.0, -73.3)], MARKETING
    )
    item = rules.detect_marketing_decline(worse, defaults("marketing")).first()
    assert (item.severity, item.kpi_to_monitor) == ("high", "roas[Kestrel / paid_social]")
    assert item.supporting_kpi == {
        "current_roas": 0.8, "previous_roas": 3.0, "roas_change_pct": -73.3, "current_spend": 5000.0,
        "estimated_revenue_impact": -11000.0,
    }
    better = spark.createDataFrame(
        [(AS_OF, "Kestrel", "paid_social", 5000.0, 14500.0, 2.9, 2000.0, 6000.0, 3.0, -3.3),
         (AS_OF, "K", "tiny", 10.0, 1.0, 0.1, 999.99, 5.0, 2.0, -95.0),
         (AS_OF, "K", "zero", 10.0, 1.0, 0.1, 5000.0, 0.0, 0.0, None)],
        MARKETING,
    )
    assert rules.detect_marketing_decline(better, defaults("marketing")).count() == 0


def test_marketing_judges_the_unrounded_change_and_sales_the_rounded_one(spark):
    nearly = spark.createDataFrame(
        [(AS_OF, "K", "s", 1.0, 0.80003, 0.80003, 2000.0, 2000.0, 1.0, -20.0)], MARKETING
    )
    assert rules.detect_marketing_decline(nearly, defaults("marketing")).count() == 0
    sales = spark.createDataFrame(
        [(AS_OF, "A", "web", 800.3, 1000.0, -199.7, -20.0), (AS_OF, "A", "b", 0.0, 499.99, -499.99, -100.0),
         (AS_OF, "A", "new", 900.0, 0.0, 900.0, None), (AS_OF, "A", "deep", 650.0, 1000.0, -350.0, -35.0)],
        "as_of date, brand string, channel string, current_net_revenue double, previous_net_revenue double, "
        "change double, pct_change double",
    )
    found = {r.affected["channel"]: r for r in rules.detect_sales_decline(sales, defaults("sales")).collect()}
    assert {k: v.severity for k, v in found.items()} == {"web": "medium", "deep": "high"}
    assert found["web"].supporting_kpi["estimated_revenue_impact"] == -199.7
    assert found["web"].likely_drivers == ["Net revenue moved from 1000 to 800 (-20.0%)."]
    assert found["web"].headline == "Material sales decline in A / web"


def test_mix_shift(spark):
    schema = "as_of date, current_new_share double, previous_new_share double"
    mix = spark.createDataFrame(
        [(AS_OF, 0.196, 0.545), (day("2026-09-20"), 0.3, 0.4), (day("2026-09-19"), 0.31, 0.4),
         (day("2026-09-18"), None, 0.4), (day("2026-09-17"), 0.0, 0.0)],
        schema,
    )
    found = rules.detect_customer_mix(mix, defaults("customer")).collect()
    assert {(str(r.as_of), r.severity, r.supporting_kpi["pct_change"]) for r in found} == {
        ("2026-09-21", "high", -64.0), ("2026-09-20", "medium", -25.0),
    }
    assert all(r.affected == {} and r.kpi_to_monitor == "new_customer_share" for r in found)


def test_resolution(spark):
    schema = "lens string, issue_type string, kpi_to_monitor string, severity string"
    before = spark.createDataFrame([("s", "t", "a", "high"), ("s", "t", "b", "low")], schema)
    after = spark.createDataFrame([("s", "t", "b", "high"), ("s", "t", "c", "low")], schema)
    got = rules.resolution(before, after).select("kpi_to_monitor", "severity_before", "severity_after", "status")
    assert rows(got) == [
        ("a", "high", None, "resolved"), ("b", "low", "high", "persisting"), ("c", None, "low", "new"),
    ]


def test_resolution_of_one_frame(spark):
    schema = "as_of date, lens string, issue_type string, kpi_to_monitor string, severity string"
    first, last = day("2026-09-01"), day("2026-09-08")
    data = [(first, "s", "t", "a", "high"), (first, "s", "t", "b", "low"), (last, "s", "t", "b", "high"),
            (last, "s", "t", "c", "low"), (day("2026-09-03"), "s", "t", "d", "low")]
    got = rules.resolution_between(spark.createDataFrame(data, schema), first, last)
    assert rows(got.select("kpi_to_monitor", "severity_before", "severity_after", "status")) == [
        ("a", "high", None, "resolved"), ("b", "low", "high", "persisting"), ("c", None, "low", "new"),
    ]


def test_report_order(spark):
    data = [("low", 0, None, ["a"]), ("high", 3, 2.0, ["a"]), ("high", 0, -5.0, ["b"]), ("high", 0, -5.0, ["a"]),
            ("medium", 1, 0.0, ["a"]), ("high", 3, None, ["z"])]
    frame = spark.createDataFrame(data, "severity string, lens_order int, order_value double, order_key array<string>")
    got = [(r.severity, r.lens_order, r.order_value, r.order_key[0]) for r in frame.orderBy(*rules.by_severity()).collect()]
    assert got == [
        ("high", 0, -5.0, "a"), ("high", 0, -5.0, "b"), ("high", 3, None, "z"), ("high", 3, 2.0, "a"),
        ("medium", 1, 0.0, "a"), ("low", 0, None, "a"),
    ]


def test_rules_do_not_shuffle(spark):
    frame = spark.range(10).selectExpr(
        "date'2026-01-01' as_of", "string(id) brand", "'c' channel", "1000D * id current_net_revenue",
        "9000D previous_net_revenue", "-10D change", "-50D pct_change",
    )
    plan = rules.detect_sales_decline(frame, defaults("sales"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
