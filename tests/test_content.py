"""Digests, checked loads, positions, distinct counts, lifetimes, increments."""

import datetime as dt
import random
from pathlib import Path

import pytest
from conftest import day, rows
from pyspark.sql import functions as F
from test_refresh import END, tables

from tradewind.operators import digest, rules
from tradewind.operators.periods import Anchors, distinct_totals
from tradewind.operators.ranking import positions
from tradewind.plans import history as H
from tradewind.plans import increment
from tradewind.plans import refresh as R
from tradewind.plans.lens import Settings
from tradewind.sources import schemas, storage

LINES = "k int, v string, n double"


def test_digest_ignores_order_and_sees_every_change(spark):
    data = [(i, None if i % 3 else f"v{i}", float(i)) for i in range(20)]
    base = digest.digest(spark.createDataFrame(data, LINES))
    assert digest.digest(spark.createDataFrame(data[::-1], LINES).repartition(3)) == base
    for other in (data[1:], data + data[:1], [(0, "w", 0.0), *data[1:]], [(1, None, 1.0)] * 20):
        assert digest.digest(spark.createDataFrame(other, LINES)) != base
    swapped = spark.createDataFrame([("a", None)], "x string, y string"), spark.createDataFrame([(None, "a")], "x string, y string")
    assert digest.digest(swapped[0]) != digest.digest(swapped[1])
    assert digest.digest(spark.createDataFrame([], LINES)) == digest.Digest(0, 0, 0)


def test_row_differences_by_kind(spark):
    old = spark.createDataFrame([(i, "v", 1.0) for i in range(50)] + [(50, "a", 1.0), (50, "b", 1.0)], LINES)
    changed = [(i, "v", 2.0 if i == 3 else 1.0) for i in range(50) if i != 4] + [(5, "v", 1.0), (50, "b", 1.0), (50, "a", 1.0), (60, None, None)]
    new = spark.createDataFrame(changed, LINES)
    want = [(3, "altered", 1, 1), (4, "lost", 1, 0), (5, "repeated", 1, 2), (60, "added", 0, 1)]
    for buckets in (1, 7, 4096):
        assert rows(digest.row_differences(old, new, ["k"], buckets)) == sorted(want, key=lambda r: tuple(map(str, r)))
    assert digest.row_differences(old, old.repartition(5), ["k"]).count() == 0


def test_a_truncated_file_leaves_every_table_as_it_was(spark, tmp_path):
    landing, store = f"{tmp_path}/landing", f"{tmp_path}/store"
    made = tables(spark)
    R.land(made, landing, END)
    first = R.load(spark, landing, END, store, [])
    later = END + dt.timedelta(days=1)
    R.land({**made, "skus": made["skus"].limit(2)}, landing, later)
    file = max(Path(f"{landing}/orders/run_date={later}").glob("*.csv"), key=lambda p: p.stat().st_size)
    lines = file.read_text().splitlines(keepends=True)
    file.write_text("".join(lines[:-1]))
    file.with_name(f".{file.name}.crc").unlink()
    with pytest.raises(storage.LoadMismatch, match="orders: expected"):
        R.load(spark, landing, later, store, [])
    now = R.current(spark, store, [])
    assert now["skus"].count() == 9 and rows(now["orders"]) == rows(first["orders"])
    file.write_text("".join(lines).replace("40.0", "41.0", 1))
    with pytest.raises(storage.LoadMismatch, match="orders: other values"):
        R.load(spark, landing, later, store, [])
    file.write_text("".join(lines))
    assert R.load(spark, landing, later, store, [])["skus"].count() == 2
    with pytest.raises(storage.LoadMismatch, match="nothing says"):
        storage.replace_checked({"skus": made["skus"]}, {}, f"{store}/raw")


def test_positions_equal_row_numbers(spark):
    chance = random.Random(2)
    data = [(chance.choice("ab" if i % 3 else "c"), chance.randrange(40), i) for i in range(500)]
    frame = spark.createDataFrame(data, "g string, x int, i int").repartition(6)
    order = [F.desc("x"), F.asc("i")]
    got = {(r.g, r.i): r.position for r in positions(frame, order, ["g"]).collect()}
    for group in "abc":
        mine = sorted((r for r in data if r[0] == group), key=lambda r: (-r[1], r[2]))
        assert [got[group, r[2]] for r in mine] == list(range(1, len(mine) + 1))
    whole = sorted(r.position for r in positions(frame, order).collect())
    assert whole == list(range(1, 501)) and positions(frame.limit(0), order).count() == 0


def test_an_entity_on_many_days_counts_once_a_period(spark):
    chance = random.Random(4)
    last = day("2026-03-01")
    data = [(chance.randrange(12), chance.choice("ab"), last - dt.timedelta(days=chance.randrange(60))) for _ in range(80)] * 2
    facts = spark.createDataFrame(data, "o int, k string, d date")
    for anchors in (Anchors.single(last, 7), Anchors.back_from(last, last - dt.timedelta(days=70), 5), Anchors((last, day("2026-02-20"), day("2026-01-30")), 9)):
        w = anchors.window_days

        def plain(as_of, key=None, shift=0):
            end = as_of - dt.timedelta(days=shift)
            return len({o for o, k, d in data if end - dt.timedelta(days=w - 1) <= d <= end and key in (None, k)})

        got = rows(distinct_totals(facts, anchors, "d", "o"))
        assert got == sorted(((a, plain(a), plain(a, None, w)) for a in anchors.dates), key=lambda r: tuple(map(str, r)))
        by_key = {(a, k): (plain(a, k), plain(a, k, w)) for a in anchors.dates for k in "ab"}
        got = {(r.as_of, r.k): (r.current_entities, r.previous_entities) for r in distinct_totals(facts, anchors, "d", "o", ["k"]).collect()}
        assert got == {at: both for at, both in by_key.items() if any(both)}


def test_lifetimes_equal_a_plain_loop(spark):
    chance = random.Random(6)
    anchors = Anchors.back_from(day("2026-03-01"), day("2025-12-01"), 5, 3)
    raised = [(a, "l", "t", k, chance.choice(rules.SEVERITIES)) for a in anchors.dates for k in "xyz" if chance.random() < 0.6]
    raised += [(anchors.latest, "l", "t", "x", "high")] * 2
    frame = spark.createDataFrame(raised, "as_of date, lens string, issue_type string, kpi_to_monitor string, severity string")
    want = []
    for key in "xyz":
        runs, current = [], None
        for a in anchors.dates:
            grades = [rules.SEVERITIES.index(s) for d, _, _, k, s in raised if d == a and k == key]
            if grades:
                current = current or [a, a, 0, 9]
                current = [current[0], a, current[2] + 1, min(current[3], *grades)]
            if current and (not grades or a == anchors.latest):
                runs.append(current)
                current = None
        for i, (first, last, n, grade) in enumerate(runs):
            want.append(("l", "t", key, first, last, n, rules.SEVERITIES[grade], i + 1, len(runs), last == anchors.latest))
    assert rows(rules.lifetimes(frame, anchors)) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_dates_that_a_day_reaches(spark):
    anchors = Anchors.back_from(END, END - dt.timedelta(days=60), 5)
    old = spark.createDataFrame([(END - dt.timedelta(days=i), i) for i in range(60)], "order_date date, n int")
    new = old.withColumn("n", F.when(F.col("n") == 20, 0).otherwise(F.col("n")))
    changed = END - dt.timedelta(days=20)
    got = increment.dates_to_compute({"orders": old}, {"orders": new}, anchors, anchors.dates[2:], 10)
    assert got == [*anchors.dates[:2], *(changed + dt.timedelta(days=i) for i in range(10))]
    assert increment.dates_to_compute({"orders": old}, {"orders": old.repartition(2)}, anchors, anchors.dates, 10) == []
    extra = {"orders": old, "other": spark.range(3)}
    assert increment.dates_to_compute(extra, {**extra, "other": spark.range(4)}, anchors, anchors.dates, 10) == list(anchors.dates)


def test_an_increment_equals_a_full_refresh(spark, tmp_path):
    """A run with one more day, one altered day and fewer items, on a history that was stored before."""
    landing, store, whole = (f"{tmp_path}/{n}" for n in ("landing", "store", "whole"))
    made, cut = tables(spark), END - dt.timedelta(days=1)
    days = {"orders": "order_date", "marketing": "date", "inventory": "date"}
    earlier = {n: f.filter(F.col(days[n]) <= F.lit(cut)) if n in days else f for n, f in made.items()}
    earlier["orders"] = earlier["orders"].withColumn(
        "net_sales", F.when(F.col("order_date") == F.lit(END - dt.timedelta(days=100)), 1.0).otherwise(F.col("net_sales"))
    )
    settings = Settings(enabled=("sales", "marketing"))
    R.land(earlier, landing, cut)
    R.land(made, landing, END)
    R.refresh(spark, landing, cut, store, settings, spacing_days=10)
    got = R.refresh(spark, landing, END, store, settings, spacing_days=10, incremental=True)
    want = R.refresh(spark, landing, END, whole, settings, spacing_days=10)
    for name, frame in want.frames().items():
        kept = [c for c in frame.columns if not str(frame.schema[c].dataType).startswith("MapType")]
        assert rows(got.frames()[name].select(*kept)) == rows(frame.select(*kept)), name
    again = R.refresh(spark, landing, END, store, settings, spacing_days=10, incremental=True)
    assert again.header.count() == want.header.count()
    with pytest.raises(ValueError, match="build it anew"):
        R.refresh(spark, landing, END, store, Settings(enabled=("sales",)), incremental=True)
    assert set(schemas.CORE_TABLES) <= set(made) and H.open_history(spark, f"{store}/history").lenses
