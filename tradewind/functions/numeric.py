"""Money, ratios and rounding as Catalyst expressions.

Money is summed as DECIMAL with six decimals: no fraction of a cent is lost in a
row, the sum is exact, and so it does not depend on row order or partitioning.
It is rounded once, where a KPI is shown. ANSI mode raises on overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(value: str) -> str:
    """SQL for an amount of money as an exact number."""
    return f"cast({value} as decimal(18,6))"


def dollars(total: Column, digits: int | None = None) -> Column:
    """A sum of amounts as DOUBLE, rounded half away from zero if asked."""
    return (total if digits is None else F.round(total, digits)).cast("double")


def discounted(price: Column, discount: Column) -> Column:
    """Price less a discount share, as exact money in whole cents."""
    return F.round(price.cast("decimal(18,6)") * (F.lit(1).cast("decimal(1,0)") - discount.cast("decimal(9,6)")), 2)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct_change(current: Column, previous: Column) -> Column:
    """Relative change in percent, one decimal; NULL where previous is zero."""
    return F.round(ratio(current - previous, previous) * F.lit(100.0), 1)


def total(value: Column) -> Column:
    """Sum of doubles, each rounded to four decimals (halves away from zero), exact in any order; NULL without values.

    Numbers below a million that are no tie are rounded as integers, which is many times
    faster: a double and its shortest text differ by far less than what is left to the tie.
    """
    shifted = value * F.lit(10000.0)
    whole = F.rint(shifted)
    plain = (F.abs(shifted) < 1e10) & (F.abs(shifted - whole) < 0.4999)
    fast = F.sum(F.when(plain, whole.cast("bigint"))).cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(4,4)")
    slow = F.sum(F.when(~plain, F.round(value, 4).cast("decimal(28,4)")))
    none = F.lit(0).cast("decimal(38,4)")
    return F.when(F.count(value) > 0, F.coalesce(fast, none) + F.coalesce(slow, none)).cast("double")


def digits_of(value: str, digits: int, thousands: bool = False) -> str:
    """SQL for the fixed-point text of a DOUBLE, half to even on its exact
    binary value: 0.15 is stored slightly below the tie and gives 0.1, 0.25 is
    a real tie and gives 0.2."""
    pattern = "0" + "." * (digits > 0) + "0" * digits
    shown = str(digits) if thousands else f"'{pattern}'"
    return f"format_number({value}, {shown})"


def round_half_even(value: str, digits: int) -> str:
    """SQL for the nearest DOUBLE with `digits` decimals, decided on the exact
    binary value."""
    return f"double({digits_of(value, digits)})"
