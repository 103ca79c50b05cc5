"""Every registered query against DuckDB on the smallest tables, and the
shape of the plans."""

import os

import duckdb
import pytest
from conftest import TABLES, rows

import __spark_entry__ as driver
from tradewind.catalog import oracle
from tradewind.catalog.queries import registered

# The queries of the optional subpackage have their own tests.
QUERIES, SQL = registered(), oracle.statements()
SOURCES = ("lineitem", "orders", "part", "customer", "events")

# Runs that combine all lenses take ten seconds each; one of each kind is
# checked by default, all with TRADEWIND_ALL=1.
COMBINED = {
    "threshold_sweep", "issue_resolution", "severity_counts", "filter_decisions", "filter_counts", "kpi_trend",
    "executive_summary", "snapshot", "snapshot_roundtrip", "copy_prompt", "kpi_expectations", "localized_decisions",
    "history_increment",
}
CHECKED = [n for n in QUERIES if (os.environ.get("TRADEWIND_ALL") or n not in COMBINED)]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    picked = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in picked) for r in want.fetchall()), key=lambda r: tuple(map(str, r)))
    assert rows(got.select(*(f"`{c}`" for c in columns))) == expected


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


UNSTORED = [n for n in QUERIES if n not in COMBINED and n not in {
    "top_issues", "snapshot_history", "fact_document", "csv_roundtrip", "row_count_reconciliation", "kpi_parity",
    "ranked_issues", "report_orders", "content_reconciliation", "checked_replace", "section_parity", "load_rejects",
}]


def test_no_plan_has_a_nested_loop_or_a_python_stage(spark):
    for name in UNSTORED:
        text = plan(QUERIES[name](spark, TABLES))
        for unwanted in ("NestedLoop", "CartesianProduct", "Python", "ArrowEval", "InMemoryTableScan"):
            assert unwanted not in text, (name, unwanted)


def test_period_filter_and_column_pruning_reach_the_scans(spark):
    text = plan(QUERIES["sales_by_brand_channel"](spark, TABLES))
    assert "GreaterThanOrEqual(o_orderdate,2001-06-03T00:00)" in text
    assert "LessThan(o_orderdate" in text.split("PushedFilters", 1)[1]
    assert "l_tax" not in text and "p_name" not in text


def test_many_dates_need_one_more_exchange_than_the_daily_sums(spark):
    frame = QUERIES["customer_summary"](spark, TABLES)
    assert plan(frame).count("Exchange hashpartitioning") <= 2
    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet").selectExpr(
        "cast(l_shipdate as date) d", "l_partkey k", "bigint(l_quantity) n"
    )
    from tradewind.catalog.queries import Dates
    from tradewind.operators.periods import period_totals

    text = plan(period_totals(lines, Dates.of(spark, TABLES).stock_days, "d", ["k"], {"n": "n"}))
    assert text.count("Exchange hashpartitioning") == 2


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
