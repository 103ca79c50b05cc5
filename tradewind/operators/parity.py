"""Comparison of whole histories, section by section, in two levels.

Level one: both sides are summed up per date and range of keys as order-free
digests. A value with a rounding tolerance enters as its cell in a grid as fine as that
tolerance, twice, in two grids that overlap by half a cell: equal digests in one
grid prove that every value of the range is within tolerance. Level two: rows of
the ranges that agree in neither grid are compared cell by cell. So only one row
per range is shuffled where two histories agree, whatever they hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import compare
from .digest import measures

#: Key ranges of a date that are compared by digest before any row is.
RANGES = 256


def _in_grid(field: T.StructField, shift: float) -> Column:
    """The value, or its cell where one rounding step is tolerated."""
    step = compare.ROUNDING_STEP.get(field.name)
    if step is None or not isinstance(field.dataType, T.NumericType):
        return F.col(field.name).alias(field.name)
    return F.floor(F.col(field.name).cast("double") / step + shift).alias(field.name)


def _sums(side: DataFrame, by: Sequence[str], keys: Sequence[str], ranges: int, name: str) -> DataFrame:
    """One row per date and range: a digest of its rows in either grid."""
    key_range = F.pmod(F.xxhash64(*keys), F.lit(ranges)) if keys else F.lit(0).cast("long")
    fields = sorted((f for f in side.schema.fields if f.name not in by), key=lambda f: f.name)
    names = [f.name for f in fields]
    grids = [F.struct(*(_in_grid(f, shift) for f in fields)) for shift in (0.0, 0.5)]
    spread = side.select(*by, key_range.alias("_range"), *(g.alias(f"_g{i}") for i, g in enumerate(grids)))
    digests = [F.struct(*measures([f"_g{i}.{n}" for n in names])).alias(f"_{name}{i}") for i in range(2)]
    return spread.groupBy(*by, "_range").agg(*digests)


def differing_ranges(
    left: DataFrame, right: DataFrame, by: Sequence[str], keys: Sequence[str], ranges: int = RANGES
) -> DataFrame:
    """Dates and ranges of keys that agree in neither grid."""
    a, b = _sums(left, by, keys, ranges, "a"), _sums(right, by, keys, ranges, "b")
    same = F.col("_a0").eqNullSafe(F.col("_b0")) | F.col("_a1").eqNullSafe(F.col("_b1"))
    return a.join(b, [*by, "_range"], "full").filter(~same).select(*by, "_range")


def section_differences(
    left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ("as_of",), ranges: int = RANGES
) -> DataFrame:
    """The cells that differ beyond tolerance, as `compare.differences` reports them.

    Both sides have the same columns and one row per date and `keys`; NULL keys match no row
    of the other side. Read twice each: pass stored frames where they are costly.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    found = differing_ranges(left, right, by, keys, ranges)
    key_range = F.pmod(F.xxhash64(*keys), F.lit(ranges)) if keys else F.lit(0).cast("long")
    sides = [
        side.withColumn("_range", key_range).join(found, [*by, "_range"], "left_semi").select(*left.columns)
        for side in (left, right)
    ]
    if by or keys:
        return compare.differences(*sides, [*by, *keys])
    single = [side.withColumn("_row", F.lit(0)) for side in sides]  # sections of one row
    return compare.differences(*single, ["_row"]).drop("_row")


def history_agreement(
    left: Mapping[str, DataFrame], right: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], ranges: int = RANGES
) -> DataFrame:
    """Per frame: rows compared, rows on one side only, cells that differ.
    `keys` names the frames and their key columns besides the date; ``decisions`` are compared fact by fact."""

    def agreed(name: str) -> DataFrame:
        if name == "decisions":
            return compare.item_agreement(left[name], right[name])
        by = [c for c in ("as_of",) if c in left[name].columns]
        return compare.counted(left[name], section_differences(left[name], right[name], keys[name], by, ranges))

    return reduce(DataFrame.unionByName, [agreed(name).select(F.lit(name).alias("frame"), "*") for name in keys])
