"""What keeps work in bounds as tables grow: what is shuffled, sorted, written."""

import datetime as dt
import random

from conftest import TABLES, rows
from pyspark.sql import functions as F

from tradewind.catalog import queries
from tradewind.catalog.queries import Dates, registered, together
from tradewind.functions import numeric
from tradewind.operators import decisions, inventory, ledger, quality
from tradewind.plans import history as H
from tradewind.sources import star_schema as S


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_duplicate_days_are_those_of_any_keys(spark):
    day = dt.date(2001, 1, 1)
    data = [(k, day + dt.timedelta(days=i)) for k in (1, 2, None) for i in range(-40, 40)]
    data += [(1, day), (1, day), (2, day), (2, None), (3, None), (3, None), (None, day)]
    table = spark.createDataFrame(data, "k int, d date")
    got = quality.duplicate_days("t", table, "k", "d")
    assert rows(got) == rows(quality.duplicate_keys("t", table, ["k", "d"])) == [("t", "unique_key", 4)]
    assert rows(quality.duplicate_days("t", table.limit(0), "k", "d")) == [("t", "unique_key", 0)]


def test_no_exchange_holds_every_sku_and_day(spark):
    text = plan(registered()["table_invariants"](spark, TABLES))
    assert not [line for line in text.split("\n") if "Exchange hashpartitioning(sku_id" in line and ", date" in line]



def test_velocity_from_spans_is_that_of_days(spark):
    d = Dates.of(spark, TABLES)
    daily = inventory.sku_velocity(S.inventory(spark, TABLES, d.clock), d.stock_as_of)
    spans = inventory.sku_velocity(S.stock_spans(spark, TABLES, d.clock), d.stock_as_of)
    assert rows(daily.filter("sku_id < 50")) == rows(spans.filter("sku_id < 50"))


def test_histories_are_compressed_and_few_issues_are_the_top_ones(spark, tmp_path):
    d = Dates.of(spark, TABLES)
    built = together(spark, TABLES, d, d.together)
    H.write_history(built, str(tmp_path))
    files = list(tmp_path.glob("[!_]*/as_of=*/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    read = H.open_history(spark, str(tmp_path)).decisions
    assert read.count() == built.decisions.count()
    few = decisions.few_issues(built.decisions, 5)
    show = [F.col(c) for c in ("as_of", "rank", "headline", "possible_action")]
    assert few.count() < 50
    assert rows(decisions.top_issues(few).select(*show)) == rows(decisions.top_issues(built.decisions).select(*show))


def test_sales_are_dealt_to_the_ledger_before_they_count_on_several_days(spark):
    text = plan(S.stock_moves(spark, TABLES, Dates.of(spark, TABLES).clock))
    assert "Generate" in text and "Exchange" not in text[: text.index("Generate")]
    # Sales come to it once: nothing is joined with itself.
    assert text.count("Generate") == 1


def test_a_day_with_returns_is_summed_before_it_counts(spark):
    day = dt.date(2001, 1, 1)
    skus = spark.createDataFrame([("a", "A", 10)], "sku_id string, brand string, opening0 bigint")
    sold = [("a", day, 5), ("a", day, -2), ("a", day + dt.timedelta(1), -3), ("a", day + dt.timedelta(1), None), ("b", day, 4)]
    lines = spark.createDataFrame(sold, "sku_id string, date date, units bigint")
    end = day + dt.timedelta(7)
    got = ledger.stock_moves(lines, skus, day, end).select("date", "demand", "receipts", "closing_stock")
    receipts = rows(got)[0][2]
    assert rows(got) == [(day, 3, receipts, 7 + receipts), (end, 0, 3, 10 + receipts)]
    summed = lines.groupBy("sku_id", "date").agg(F.sum("units").alias("units"))
    assert rows(ledger.stock_moves(summed, skus, day, end).select(*got.columns)) == rows(got)


def test_totals_are_those_of_decimals(spark):
    pick = random.Random(1)
    values = [0.00005, 1.00005, -1.00005, 2.675, 0.12345, 1e6 + 0.00005, 123456789.12345, -0.0, None, 4e9]
    values += [pick.uniform(-1e7, 1e7) for _ in range(300)] + [round(pick.uniform(0, 99), 5) for _ in range(300)]
    frame = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)] + [(None, 9)], "v double, k int")
    want = F.sum(F.round("v", 4).cast("decimal(28,4)")).cast("double")
    assert rows(frame.groupBy("k").agg(numeric.total(F.col("v")))) == rows(frame.groupBy("k").agg(want))


def test_sections_are_shuffled_by_date_only_to_be_written(spark):
    d = Dates.of(spark, TABLES)
    assert not together(spark, TABLES, d, d.together).by_date
    assert "inventory.risk_by_sku" in together(spark, TABLES, d, d.together, by_date=True).by_date


def test_report_orders_sort_keys_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "positions", lambda frame, *_: (seen.append(frame.columns), frame.withColumn("position", F.lit(1)))[1])
    registered()["report_orders"](spark, TABLES)
    assert ["as_of", "sku_id", "days_of_cover"] in seen and all(len(c) <= 4 for c in seen)


def test_a_task_reads_little_of_a_shuffle(spark):
    registered()["latest_date"](spark, TABLES)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
