"""Delivered rows dealt into kept and rejected ones, none lost on the way."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reason of rows whose key another row has that comes first.
DUPLICATE = "duplicate"


class Parent(NamedTuple):
    """Rows without a partner here are orphans; a column of `frame` named as one of the rows."""

    reason: str
    frame: DataFrame
    column: str


def sorted_out(
    delivered: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    malformed: Mapping[str, Column],
    parents: Sequence[Parent] = (),
) -> DataFrame:
    """Every distinct row with ``copies`` (how many were delivered), ``kept`` (0 or 1 of
    them) and ``reason`` (why the others, or all, are rejected; NULL if none is).

    The first condition of `malformed` that holds, or is NULL, names the reason; a key must not be
    NULL. Then come parents, in their order, and then duplicates: the first row by `order`
    and all other columns (NULL last) stays. So for any input
    ``sum(copies) = sum(kept) + sum(copies - kept)``, and a rejected row takes no key from a good one.

    Equal rows are counted in map tasks first. The first row per key is a minimum, joined back, and
    no window: copies and versions of one key are never sorted in one task.
    """
    columns = delivered.columns
    checks = {**malformed, "no key": reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])}
    reason = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))
    counted = delivered.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("reason", reason)
    bad, rest = counted.filter(F.col("reason").isNotNull()), counted.filter(F.col("reason").isNull())
    for parent in parents:
        known = parent.frame.select(parent.column).distinct().withColumn("_known", F.lit(True))
        missing = F.col("_known").isNull() & F.col("reason").isNull()
        rest = rest.join(known, parent.column, "left").withColumn(
            "reason", F.when(missing, F.lit(parent.reason)).otherwise(F.col("reason"))
        ).drop("_known")
    ties = [c for c in [*order, *(c for c in columns if c not in order)] if c not in keys]
    place = F.struct(*(part for c in ties for part in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))), F.lit(0).alias("_end"))
    rest = rest.withColumn("_place", F.when(F.col("reason").isNull(), place))
    first = rest.groupBy(*keys).agg(F.min("_place").alias("_first"))
    dealt = rest.join(first, list(keys)).withColumn("_kept", F.col("reason").isNull() & F.col("_place").eqNullSafe(F.col("_first")))
    extra = F.col("reason").isNull() & (~F.col("_kept") | (F.col("copies") > 1))
    dealt = dealt.select(
        *columns,
        "copies",
        F.col("_kept").cast("bigint").alias("kept"),
        F.when(extra, F.lit(DUPLICATE)).otherwise(F.col("reason")).alias("reason"),
    )
    return dealt.unionByName(bad.select(*columns, "copies", F.lit(0).cast("bigint").alias("kept"), "reason"))


def kept(dealt: DataFrame) -> DataFrame:
    """The rows that stay, once each."""
    return dealt.filter("kept = 1").drop("copies", "kept", "reason")


def rejected(dealt: DataFrame) -> DataFrame:
    """The rows that go, with the reason and how many of them."""
    return dealt.filter("copies > kept").withColumn("copies", F.col("copies") - F.col("kept")).drop("kept")
