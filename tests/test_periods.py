import datetime as dt
import random

import pytest
from conftest import day, in_order, rows
from pyspark.sql import functions as F

from tradewind.operators import periods as P
from tradewind.operators.periods import Anchors


def test_windows_are_contiguous_and_equally_long(spark):
    got = Anchors.single(day("2026-09-21")).frame(spark).first()
    assert tuple(got) == (
        day("2026-09-21"),
        day("2026-08-23"),
        day("2026-09-21"),
        day("2026-07-24"),
        day("2026-08-22"),
    )


def test_tagging_at_the_edges(spark):
    as_of = day("2026-09-21")
    ages = [-1, 0, 29, 30, 59, 60]
    frame = spark.createDataFrame([(a, as_of - dt.timedelta(days=a)) for a in ages], "age int, d date")
    tagged = frame.select("age", P.period_of(F.col("d"), F.lit(as_of), 30).alias("p")).collect()
    assert {r.age: r.p for r in tagged} == {
        -1: None, 0: "current", 29: "current", 30: "previous", 59: "previous", 60: None,
    }


def test_history_of_120_days_has_61_dates():
    anchors = Anchors.back_from(day("2026-09-21"), day("2026-05-25"))
    assert len(anchors.dates) == 61
    assert (anchors.dates[0] - day("2026-05-25")).days >= 59
    assert anchors.latest == day("2026-09-21")
    assert len(Anchors.back_from(day("2026-09-21"), day("2026-05-25"), count=7).dates) == 7
    assert Anchors.back_from(day("2026-09-21"), day("2026-05-25"), spacing_days=30).step == 30


def test_no_room_for_two_periods_is_an_error():
    with pytest.raises(ValueError):
        Anchors.back_from(day("2026-02-01"), day("2026-01-01"))


def _dated(spark, column, *days):
    return spark.createDataFrame([(d,) for d in days], f"{column} date")


def test_latest_date_ignores_empty_tables(spark):
    orders = _dated(spark, "order_date", day("2026-01-01"), day("2026-05-01"))
    empty = _dated(spark, "date")
    stock = _dated(spark, "date", day("2026-06-01"))
    bounds = P.data_bounds(orders, empty, stock)
    assert tuple(bounds.first()) == (day("2026-06-01"), day("2026-01-01"))
    resolved = P.resolve_anchors(orders, empty, stock, 30, 7, 3)
    assert rows(P.history_anchors(bounds, 30, 7, 3)) == [(d,) for d in resolved.dates]
    with pytest.raises(ValueError):
        P.resolve_anchors(_dated(spark, "order_date"), empty, empty)


def test_history_frame_equals_literal_dates(spark):
    bounds = spark.createDataFrame([(day("2026-09-21"), day("2026-05-25"))], "latest date, earliest date")
    for spacing in (1, 7, 30):
        want = Anchors.back_from(day("2026-09-21"), day("2026-05-25"), 30, spacing)
        assert rows(P.history_anchors(bounds, 30, spacing)) == [(d,) for d in want.dates]
    short = spark.createDataFrame([(day("2026-01-10"), day("2026-01-01"))], "latest date, earliest date")
    assert P.history_anchors(short, 30).count() == 0


def test_nearest_anchor(spark):
    available = _dated(spark, "as_of", day("2026-08-01"), day("2026-08-03"), day("2026-08-04"))
    picked = _dated(spark, "picked", day("2026-08-03"), day("2026-08-02"), day("2026-07-01"), day("2026-08-03"))
    assert rows(P.nearest_anchor(picked, available)) == [
        (day("2026-07-01"), day("2026-08-01")),
        (day("2026-08-02"), day("2026-08-01")),
        (day("2026-08-03"), day("2026-08-03")),
    ]


def _expected(data, anchors, keyed):
    out = {}
    w = anchors.window_days
    for a in anchors.dates:
        if not keyed:
            out[a, None] = [0, 0]
        for k, d, n in data:
            age = (a - d).days
            if 0 <= age < 2 * w:
                out.setdefault((a, k if keyed else None), [0, 0])[0 if age < w else 1] += n
    return in_order((a, k, c, p) if keyed else (a, c, p) for (a, k), (c, p) in out.items())


@pytest.mark.parametrize(
    "name", ["one", "daily", "weekly", "wide", "irregular"],
)
def test_totals_match_brute_force(spark, name):
    start = day("2026-01-01")
    pick = random.Random(name)
    data = [("hot" if pick.random() < 0.4 else pick.choice("abcd"), start + dt.timedelta(days=pick.randrange(90)), pick.randrange(-5, 50)) for _ in range(400)]
    last = start + dt.timedelta(days=89)
    anchors = {
        "one": Anchors.single(last - dt.timedelta(days=3), 10),
        "daily": Anchors.back_from(last, start, 7),
        "weekly": Anchors.back_from(last, start, 10, 7),
        "wide": Anchors.back_from(last, start, 3, 30),
        "irregular": Anchors((day("2026-02-01"), day("2026-02-02"), day("2026-03-15"), day("2026-06-01")), 12),
    }[name]
    frame = spark.createDataFrame(data, "k string, d date, n bigint").repartition(5)
    assert rows(P.period_totals(frame, anchors, "d", ["k"], {"n": "n"})) == _expected(data, anchors, True)
    assert rows(P.period_totals(frame, anchors, "d", [], {"n": "n"})) == _expected(data, anchors, False)
    current = P.period_totals(frame, anchors, "d", ["k"], {"n": "n", "rows": "1L"}, previous=False)
    want = {}
    for a in anchors.dates:
        for k, d, n in data:
            if 0 <= (a - d).days < anchors.window_days:
                total = want.setdefault((a, k), [0, 0])
                total[0] += n
                total[1] += 1
    assert rows(current) == in_order((a, k, n, c) for (a, k), (n, c) in want.items())
    is_anchor = frame.select("d").distinct().filter(anchors.holds(F.col("d")))
    assert {r.d for r in is_anchor.collect()} == {d for _, d, _ in data} & set(anchors.dates)
