import json

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from tradewind.functions.prose import LOCALIZED
from tradewind.operators import decisions as D
from tradewind.operators import reports
from tradewind.plans import lens as L
from tradewind.plans.history import localized

A, B = day("2026-09-20"), day("2026-09-21")

ITEM = (
    "as_of date, lens string, lens_order int, issue_type string, severity string, headline string, "
    "supporting_kpi map<string,double>, likely_drivers array<string>, affected map<string,string>, "
    "possible_action string, kpi_to_monitor string, order_value double, order_key array<string>"
)


def item(as_of, severity, impact, name="x", lens="sales", issue_type="sales_decline", kpi=None, affected=None):
    facts = {**(kpi or {}), "estimated_revenue_impact": impact}
    return (as_of, lens, 0, issue_type, severity, f"headline {name}", facts, ["driver"], affected or {}, "act", name, 0.0, [name])


@pytest.fixture
def items(spark):
    return lambda *data: spark.createDataFrame(list(data), ITEM)


def test_counts_show_zero_for_every_severity_and_date(spark, items):
    got = D.severity_counts(
        items(item(A, "high", 1.0, "a"), item(A, "high", 2.0, "b"), item(A, "low", None, "c")),
        spark.createDataFrame([(A,), (B,)], "as_of date"),
    )
    assert rows(got) == [(A, 2, 0, 1), (B, 0, 0, 0)]


def test_ranking(items):
    def ranked(*data):
        got = D.top_issues(items(*data), 10).orderBy("rank").collect()
        return [r.kpi_to_monitor for r in got]

    assert ranked(item(A, "high", -100.0, "a"), item(A, "high", -5000.0, "b"), item(A, "medium", None, "c")) == ["b", "a", "c"]
    assert ranked(item(A, "medium", -100000.0, "a"), item(A, "high", -1.0, "b")) == ["b", "a"]
    assert ranked(item(A, "high", None, "a"), item(A, "high", 0.0, "b"), item(A, "odd", 9.0, "c")) == ["b", "a", "c"]
    assert ranked(item(A, "low", 5.0, "b"), item(A, "low", -5.0, "a")) == ["a", "b"]


def test_top_is_per_date_and_cut_before_the_shuffle(spark, items):
    many = items(*(item(d, "high", float(n), f"{n:02}") for d in (A, B) for n in range(20)))
    top = D.top_issues(many)
    assert rows(top.groupBy("as_of").count()) == [(A, 5), (B, 5)]
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_filter(items):
    data = items(item(A, "high", 1.0, "a"), item(A, "low", 1.0, "b", lens="inventory"), item(A, "low", 1.0, "c"))
    assert D.filter_decisions(data).count() == 3
    assert [r.kpi_to_monitor for r in D.filter_decisions(data, ["sales"], ["low"]).collect()] == ["c"]
    assert rows(D.shown_and_total(data, ["sales"], ["low"])) == [(A, 1, 3)]
    assert rows(D.shown_and_total(data)) == [(A, 3, 3)]


def test_missing_lens_is_found_by_issue_type(items):
    data = items(item(A, "high", 1.0, lens=None), item(A, "high", 1.0, lens="inventory"),
                 item(A, "high", 1.0, lens=None, issue_type="unknown"))
    assert sorted(str(r.lens) for r in D.tag_lens(data, L.issue_owners()).collect()) == ["None", "inventory", "sales"]


def test_trend_follows_the_series_and_skips_missing_values(spark):
    issue = spark.createDataFrame(
        [("marketing", ["K", "s"], "t", "roas[K / s]"), ("marketing", ["K", "none"], "t", "roas[K / none]")],
        "lens string, series array<string>, issue_type string, kpi_to_monitor string",
    )
    points = spark.createDataFrame(
        [("marketing", ["K", "s"], A, 2.5), ("marketing", ["K", "s"], B, None), ("marketing", ["K", "s"], day("2026-09-22"), 1.1),
         ("sales", ["K", "s"], A, 9.0)],
        "lens string, series array<string>, as_of date, value double",
    )
    got = D.kpi_trend(issue, points).select("as_of", "value")
    assert rows(got) == [(A, 2.5), (day("2026-09-22"), 1.1)]


CASES = {
    "sales_decline": ({"current_net_revenue": 3593.36, "previous_net_revenue": 6224.64, "pct_change": -42.3},
                      {"brand": "Marlow", "channel": "retail_partner"}),
    "marketing_efficiency_decline": (
        {"current_roas": 1.29, "previous_roas": 3.16, "roas_change_pct": -59.1, "current_spend": 12345.5},
        {"brand": "Kestrel", "marketing_channel": "paid_social"}),
    "stockout_risk": ({"on_hand": 0.0, "velocity_per_day": 2.07, "days_of_cover": 0.0}, {"brand": "Aurora", "sku_id": "AUR-003"}),
    "excess_inventory_risk": ({"on_hand": 57.0, "velocity_per_day": 0.86, "days_of_cover": 66.3}, {"brand": "Aurora", "sku_id": "AUR-001"}),
    "customer_mix_shift": ({"current_new_share": 0.196, "previous_new_share": 0.545, "pct_change": -64.0}, {}),
}


def test_prose_in_both_languages(items):
    data = items(*(item(A, "high", None, t, issue_type=t, kpi=k, affected=w) for t, (k, w) in CASES.items()))
    english = {r.issue_type: r for r in localized(data, "en").collect()}
    korean = {r.issue_type: r for r in localized(data, "ko").collect()}
    for issue_type in CASES:
        for found in (english[issue_type], korean[issue_type]):
            assert found.headline and found.possible_action and found.likely_drivers[0]
            assert "{" not in found.headline + found.possible_action + found.likely_drivers[0]
        assert korean[issue_type].headline != english[issue_type].headline
        assert set(LOCALIZED[issue_type]) == {"ko", "en"}
    assert english["sales_decline"].likely_drivers == ["Net revenue moved from $6,225 to $3,593 (-42.3%)."]
    assert english["stockout_risk"].likely_drivers == [
        "Demand of ~2.1 units/day against on-hand stock of 0 leaves ~0.0 days of cover."
    ]
    assert korean["customer_mix_shift"].likely_drivers == ["신규 고객 주문 비중이 55% → 20%로 이동."]
    assert korean["marketing_efficiency_decline"].likely_drivers == [
        "ROAS가 3.16 → 1.29로 하락(-59.1%), 현재 지출은 $12,346."
    ]


def test_unknown_language_or_type_keeps_the_text(items):
    data = items(item(A, "high", None, issue_type="other"))
    assert localized(data, "ko").first().headline == "headline x"
    assert localized(items(item(A, "high", None)), "fr").first().headline == "headline x"


SUMMARY = (
    "as_of date, current_net_revenue double, current_orders bigint, current_units_sold bigint, current_aov double, "
    "previous_net_revenue double, previous_orders bigint, previous_units_sold bigint, previous_aov double, "
    "pct_net_revenue double, pct_orders double, pct_units_sold double, pct_aov double"
)


@pytest.fixture
def summary(spark):
    return spark.createDataFrame(
        [(A, 12345678.5, 10, 20, 1234.5, 200.0, 8, 16, 25.0, -12.34, 25.0, 25.0, None),
         (B, 0.0, 0, 0, 0.0, 0.0, 0, 0, 0.0, None, None, None, None)],
        SUMMARY,
    )


def test_summary_text(items, summary):
    data = items(item(A, "high", -1.0, "a"), item(A, "high", -9.0, "b"), item(A, "low", None, "c"), item(A, "low", None, "d"))
    got = dict(reports.executive_summary(data, summary, "en", {}).collect())
    assert got[A] == (
        "Net revenue change vs. prior period: -12.3%. 2 high-severity issue(s), 0 medium, 2 low. "
        "Top issues: headline b; headline a; headline c."
    )
    assert got[B] == "Net revenue change vs. prior period: n/a. 0 high-severity issue(s), 0 medium, 0 low."
    korean = dict(reports.executive_summary(data, summary, "ko", L.localizers()).collect())
    assert korean[B] == "이전 기간 대비 순매출 변화: n/a. high 0건, medium 0건, low 0건."


def test_tiles(spark, summary):
    got = {(r.as_of, r.tile): (r.label, r.value, r.delta) for r in reports.sales_tiles(summary, "en").collect()}
    assert got[A, "net_revenue"] == ("Net revenue", "$12,345,678", "-12.3%")
    assert got[A, "orders"] == ("Orders", "10", "+25.0%")
    assert got[A, "aov"] == ("AOV", "$1,234", "n/a")
    mix = spark.createDataFrame(
        [(A, 0.2, 0.57), (B, 0.2, None), (day("2026-09-19"), None, 0.1)],
        "as_of date, current_new_share double, previous_new_share double",
    )
    tiles = {r.as_of: (r.value, r.delta) for r in reports.customer_tiles(mix, "ko").collect()}
    assert tiles == {A: ("20%", "-37.0pt"), B: ("20%", None), day("2026-09-19"): ("n/a", None)}


def test_documents_are_json_with_nulls(spark, items, summary):
    data = items(*(item(A, "high", -float(n), f"{n}", kpi={"on_hand": None}) for n in range(8)))
    periods = spark.createDataFrame([(A, A, A, B, B)], "as_of date, current_start date, current_end date, previous_start date, previous_end date")
    lines = reports.fact_lines(data, summary.filter(F.col("as_of") == F.lit(A)), periods).collect()
    assert [r.kind for r in lines].count("decision") == 8
    parsed = {r.kind: json.loads(r.fact) for r in lines}
    assert parsed["period"]["previous_end"] == "2026-09-21"
    assert parsed["sales_summary"]["current"] == {"net_revenue": 12345678.5, "orders": 10, "units_sold": 20, "aov": 1234.5}
    assert parsed["sales_summary"]["pct_change"]["aov"] is None
    assert parsed["decision"]["supporting_kpi"]["on_hand"] is None
    assert set(parsed["decision"]) == {
        "issue_type", "headline", "severity", "supporting_kpi", "likely_drivers", "affected", "possible_action",
        "kpi_to_monitor", "lens",
    }
    prompt = reports.copy_prompt(data, summary, periods, "en", {}).first().prompt
    header, facts = prompt.split("\nFacts (JSON):\n")
    body = json.loads(facts)
    assert header.startswith("Brief the person who runs this shop") and body["as_of_date"] == "2026-09-20"
    assert [i["kpi_to_monitor"] for i in body["issues"]] == ["7", "6", "5", "4", "3"]
    assert set(body["issues"][0]) == {"headline", "severity", "supporting_kpi", "likely_drivers", "possible_action", "kpi_to_monitor"}
    assert reports.copy_prompt(data.limit(0), summary, periods, "ko", {}).first().prompt.endswith('"issues":[]}')


def test_changed_parameters(spark):
    base = spark.createDataFrame([("sales", "a", -35.0), ("sales", "b", 500.0), ("stock", "c", 7.0)], "lens string, key string, value double")
    changed = spark.createDataFrame([("sales", "a", -32.5), ("sales", "b", 500.0), ("stock", "c", 10.0)], "lens string, key string, value double")
    assert rows(reports.param_diff(base, changed)) == [("sales", "a", "-35 → -32.5"), ("stock", "c", "7 → 10")]
