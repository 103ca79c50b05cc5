"""Histories compared in two levels, and delivered rows dealt into kept and rejected."""

import pytest
from conftest import TABLES, day, rows
from pyspark.sql import functions as F

from tradewind.operators import compare, parity, rejects
from tradewind.operators.rejects import Parent
from tradewind.sources import star_schema as S

CELLS = "as_of date, sku int, pct_change double, note string, other double"
D1, D2 = day("2026-01-01"), day("2026-01-02")


def history(spark, data):
    return spark.createDataFrame(data, CELLS)


def test_two_levels_report_what_one_does(spark):
    base = [(d, i, i * 0.1, f"n{i % 3}" if i % 4 else None, None if i % 5 == 0 else i / 3) for d in (D1, D2) for i in range(60)]

    def changed(row):
        d, i, pct, note, other = row
        if d == D1 and i == 3:
            return d, i, pct + 5, note, other
        if i == 4:
            return d, i, pct + 0.1, note, other  # a rounding step is tolerated
        if i == 5:
            return d, i, pct, "x", other
        if i == 6:
            return d, i, None, note, None
        return d, i, pct, note, other and other * (1 + 1e-9)

    left = history(spark, base)
    right = history(spark, [changed(r) for r in base if r[1] != 7] + [(D2, 99, None, None, None)])
    want = rows(compare.differences(left, right, ["as_of", "sku"]))
    assert {(r[1], r[2]) for r in want} == {(3, "pct_change"), (5, "note"), (6, "pct_change"), (6, "other"), (7, "(row)"), (99, "(row)")}
    for ranges in (1, 5, 256):
        assert rows(parity.section_differences(left, right, ["sku"], ranges=ranges)) == want


def test_ranges_that_agree_are_not_compared(spark):
    base = [(D1, i, i * 0.1 + 0.03, "n", 1.0) for i in range(200)]
    moved = [(d, i, p + (0.01 if i % 2 else 0.0), n, o) for d, i, p, n, o in base]
    left, right = history(spark, base), history(spark, moved)
    assert parity.differing_ranges(left, left.repartition(3), ["as_of"], ["sku"]).count() == 0
    assert parity.differing_ranges(left, right, ["as_of"], ["sku"], 64).count() == 0  # within one grid's cells
    edge = history(spark, [(d, i, p + 0.099, n, o) for d, i, p, n, o in base])
    assert parity.differing_ranges(left, edge, ["as_of"], ["sku"], 64).count() > 0  # crosses both: compared by cell
    assert parity.section_differences(left, edge, ["sku"]).count() == 0


def test_sections_without_keys_dates_or_rows(spark):
    one = spark.createDataFrame([(0.5,)], "repeat_purchase_rate double")
    other = spark.createDataFrame([(0.7,)], "repeat_purchase_rate double")
    assert parity.section_differences(one, one, [], []).count() == 0
    assert [r["column"] for r in parity.section_differences(one, other, [], []).collect()] == ["repeat_purchase_rate"]
    none = history(spark, [])
    assert parity.section_differences(none, none, ["sku"]).count() == 0
    some = history(spark, [(D1, 1, None, None, None)])
    assert rows(parity.section_differences(none, some, ["sku"])) == [(D1, 1, "(row)", None, "present")]
    with pytest.raises(ValueError, match="columns differ"):
        parity.section_differences(none, some.drop("note"), ["sku"])


LINES = "k int, n int, parent int, q int"


def dealt(spark, data):
    known = spark.createDataFrame([(1,), (1,), (2,)], "parent int")
    return rejects.sorted_out(
        spark.createDataFrame(data, LINES), ["k", "n"], ["q"], {"quantity": F.col("q") >= 0}, [Parent("orphan", known, "parent")]
    )


def test_kept_and_rejected_are_what_was_delivered(spark):
    data = (
        [(1, 1, 1, 5)] * 4  # copies
        + [(1, 2, 1, 7), (1, 2, 1, 6), (1, 2, 2, 6)]  # versions: least quantity, then parent
        + [(2, 1, 9, 1), (2, 1, 1, 3)]  # the orphan comes first, but takes no key
        + [(3, 1, 1, -1), (3, 2, 1, None), (3, 2, None, 4)]
        + [(None, 1, 1, 1), (None, None, None, None)]
    )
    found = dealt(spark, data)
    assert rows(rejects.kept(found)) == [(1, 1, 1, 5), (1, 2, 1, 6), (2, 1, 1, 3)]
    assert {tuple(r) for r in rejects.rejected(found).select("k", "n", "parent", "q", "copies", "reason").collect()} == {
        (1, 1, 1, 5, 3, "duplicate"),
        (1, 2, 1, 7, 1, "duplicate"),
        (1, 2, 2, 6, 1, "duplicate"),
        (2, 1, 9, 1, 1, "orphan"),
        (3, 1, 1, -1, 1, "quantity"),
        (3, 2, 1, None, 1, "quantity"),
        (3, 2, None, 4, 1, "orphan"),
        (None, 1, 1, 1, 1, "no key"),
        (None, None, None, None, 1, "quantity"),
    }
    total = rejects.kept(found).count() + rejects.rejected(found).agg(F.sum("copies")).first()[0]
    assert total == len(data)
    assert dealt(spark, []).count() == 0


def test_kept_lines_are_the_staged_ones(spark):
    columns = S.shipped_lines(spark, TABLES).columns
    found = S.sorted_lines(spark, TABLES)
    assert rows(rejects.kept(found).select(*columns)) == rows(S.shipped_lines(spark, TABLES))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
