"""The whole refresh on order-grain tables with four issues put in on purpose."""

import datetime as dt

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from tradewind.operators import decisions, quality, rules
from tradewind.plans import history as H
from tradewind.plans import refresh as R
from tradewind.plans.lens import Settings
from tradewind.sources import schemas, storage

END = day("2026-09-21")
START = END - dt.timedelta(days=119)
BRANDS = ("Aurora", "Kestrel", "Marlow")
CHANNELS = ("online_dtc", "marketplace", "retail_partner")
MEDIA = ("paid_search", "paid_social", "affiliate")


def calendar():
    for i in range(120):
        today = START + dt.timedelta(days=i)
        yield i, today, (END - today).days < 30


def tables(spark):
    orders, people, n = [], {}, 0
    for i, today, recent in calendar():
        for brand in BRANDS:
            for channel in CHANNELS:
                if recent and (brand, channel) == ("Marlow", "retail_partner") and i % 3:
                    continue
                n += 1
                new = n % 10 < (2 if recent else 6)
                who = f"CUST-{n if new else n % 9:05d}"
                people.setdefault(who, [today, 0, 0.0])
                people[who][1] += 1
                people[who][2] += 40.0
                orders.append((f"ORD-{n:06d}", today, f" {brand}", channel, f"{brand[:3].upper()}-001", who, new, 2, 20.0, 0.0, 40.0))
    orders.append(orders[0])
    spend = []
    for _, today, recent in calendar():
        for brand in BRANDS:
            for medium in MEDIA:
                factor = 2.6 if recent and (brand, medium) == ("Kestrel", "paid_social") else 1.0
                spend.append((today, brand, medium, 100.0 * factor, 1000, 50, 5, 300.0))
    stock = []
    for _, today, _ in calendar():
        for brand in BRANDS:
            for k in range(1, 4):
                sku = f"{brand[:3].upper()}-{k:03d}"
                low = sku == "AUR-003"
                stock.append((today, sku, brand, 8 if low else 64, 0, 4, 4 if low else 60))
    customers = [(who, "affiliate", first, count, total, count > 1) for who, (first, count, total) in people.items()]
    skus = [(f"{b[:3].upper()}-{k:03d}", b, 20.0, 9.0) for b in BRANDS for k in range(1, 4)]
    made = {"orders": orders, "marketing": spend, "inventory": stock, "customers": customers, "skus": skus}
    return {name: spark.createDataFrame(data, schemas.CORE_TABLES[name]) for name, data in made.items()}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    landing, store = (str(tmp_path_factory.mktemp(n)) for n in ("landing", "store"))
    R.land(tables(spark), landing, END, {"seed": 1})
    return landing, store


@pytest.fixture(scope="module")
def built(spark, folders):
    return R.refresh(spark, folders[0], END, folders[1], settings=Settings())


def test_sixty_one_dates(built):
    dates = H.available_dates(built.header)
    assert dates.count() == 61
    assert [r.as_of for r in dates.filter("is_latest").collect()] == [END]


def test_exactly_the_four_planted_issues_are_high(built):
    high = built.decisions.filter((F.col("as_of") == F.lit(END)) & (F.col("severity") == "high"))
    assert rows(high.select("issue_type", "kpi_to_monitor")) == [
        ("customer_mix_shift", "new_customer_share"),
        ("marketing_efficiency_decline", "roas[Kestrel / paid_social]"),
        ("sales_decline", "net_revenue[Marlow / retail_partner]"),
        ("stockout_risk", "days_of_cover[AUR-003]"),
    ]
    first = decisions.top_issues(built.decisions).filter((F.col("as_of") == F.lit(END)) & (F.col("rank") == 1)).first()
    assert first.issue_type == "marketing_efficiency_decline"
    assert first.supporting_kpi["estimated_revenue_impact"] == 9000.0 - 7800.0 * 3.0


def test_nothing_is_reported_before_the_change(built):
    before = built.decisions.filter((F.col("as_of") == F.lit(END - dt.timedelta(days=60))) & (F.col("lens") != "inventory"))
    assert before.count() == 0
    gone = rules.resolution(
        built.decisions.filter(F.col("as_of") == F.lit(END)), before.unionByName(before)
    ).filter("lens != 'inventory'")
    assert {r.status for r in gone.collect()} == {"resolved"}


def test_expectations_hold(built):
    latest = F.col("as_of") == F.lit(END)
    sections = {n: f.filter(latest) for parts in built.sections.values() for n, f in parts.items() if "as_of" in f.columns}
    failures = quality.expectation_failures(
        sections["by_brand_channel"], sections["by_segment"], sections["mix"], sections["risk_by_sku"],
        ("Marlow", "retail_partner"), ("Kestrel", "paid_social"), "AUR-003",
    )
    assert failures.count() == 0


def test_stored_history_can_be_judged_again(spark, folders, built):
    stored = H.open_history(spark, f"{folders[1]}/history")
    assert stored.decisions.count() == built.decisions.count()
    assert H.tiles(stored, "en").filter(F.col("as_of") == F.lit(END)).count() == 4
    strict = H.sweep(stored.lenses, stored.sections, stored.params, {"s": {"sales": {"decline_medium_pct": -90.0, "decline_high_pct": -90.0}}})
    assert strict.filter("lens = 'sales'").count() == 0


def test_duplicate_order_is_counted_once(built):
    total = built.sections["sales"]["summary"].filter(F.col("as_of") == F.lit(END - dt.timedelta(days=60))).first()
    assert total.previous_orders == 270 and total.previous_net_revenue == 270 * 40.0


def test_a_lost_row_stops_the_refresh(spark, folders):
    manifest = {r.key: r.value for r in storage.read_manifest(spark, folders[0]).collect()}
    assert manifest["end_date"] == "2026-09-21" and manifest["seed"] == "1"
    assert int(manifest["delivered.skus.rows"]) == 9
    one = spark.range(1)
    with pytest.raises(storage.LoadMismatch):
        storage.verify_load({"orders": spark.range(2)}, {"orders": one})


def test_extra_table_may_not_take_a_core_name(spark):
    from tradewind.plans.lens import DataSource, Lens

    bad = Lens("x", {"en": "x"}, compute=None, detect=None, data_sources=(DataSource("orders", schemas.ORDERS, None),))
    with pytest.raises(ValueError, match="orders"):
        R.run_schemas([bad])
