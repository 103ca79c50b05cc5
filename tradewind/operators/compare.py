"""Comparison of two KPI tables within rounding tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size of the last rounded digit per KPI. A KPI that is not
# listed must agree to one part in a million.
_KPI_STEP = {
    "pct_change": 0.1,
    "roas_change_pct": 0.1,
    "days_of_cover": 0.1,
    "velocity": 0.01,
    "aov": 0.01,
    "net_revenue": 0.01,
    "cac": 0.01,
    "current_new_share": 0.001,
    "previous_new_share": 0.001,
    "current_returning_share": 0.001,
    "previous_returning_share": 0.001,
    "repeat_purchase_rate": 0.001,
}
_SUMMARY_KPIS = ("net_revenue", "orders", "units_sold", "aov")
# By column name: a KPI itself, its two sides, and its percent change.
ROUNDING_STEP = {
    **_KPI_STEP,
    **{f"{side}_{kpi}": _KPI_STEP[kpi] for side in ("current", "previous") for kpi in ("net_revenue", "aov")},
    **{f"pct_{kpi}": _KPI_STEP["pct_change"] for kpi in _SUMMARY_KPIS},
}
STEP_MARGIN = 1.01
RELATIVE = 1e-6
ABSOLUTE = 1e-9


def _same(name: str, kind: T.DataType, a: Column, b: Column) -> Column:
    if not isinstance(kind, T.NumericType):
        return a.eqNullSafe(b)
    a, b = a.cast("double"), b.cast("double")
    allowed = F.greatest(
        F.lit(RELATIVE) * F.greatest(F.abs(a), F.abs(b)),
        F.lit(ROUNDING_STEP.get(name, 0.0) * STEP_MARGIN + ABSOLUTE),
    )
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= allowed)


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cell that disagrees: keys, column and both values as text.
    A row present on one side only is reported once, as column ``(row)``."""
    values = [f for f in left.schema.fields if f.name not in keys]
    a = left.select(*keys, F.struct(*(f.name for f in values)).alias("_a"))
    b = right.select(*keys, F.struct(*(f.name for f in values)).alias("_b"))
    joined = a.join(b, list(keys), "full")

    def cell(name: str, differs: Column, x: Column, y: Column) -> Column:
        text = (F.lit(name).alias("column"), x.cast("string").alias("a"), y.cast("string").alias("b"))
        return F.when(differs, F.struct(*text))

    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    cells = [
        cell("(row)", ~both, F.when(F.col("_a").isNotNull(), "present"), F.when(F.col("_b").isNotNull(), "present")),
        *(
            cell(
                f.name,
                both & ~_same(f.name, f.dataType, F.col(f"_a.{f.name}"), F.col(f"_b.{f.name}")),
                F.col(f"_a.{f.name}"),
                F.col(f"_b.{f.name}"),
            )
            for f in values
        ),
    ]
    return joined.select(*keys, F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


ITEM_KEYS = ("as_of", "lens", "issue_type", "kpi_to_monitor")


def item_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences between two sets of decision items, fact by fact. Drivers
    are prose made from the facts and are not compared."""
    steps = F.create_map(*(F.lit(v) for pair in ROUNDING_STEP.items() for v in pair))

    def facts(items: DataFrame, side: str) -> DataFrame:
        texts = [
            F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("number"), F.col(c).alias("text"))
            for c in ("severity", "headline", "possible_action")
        ]
        numbers = F.transform(
            F.map_entries("supporting_kpi"),
            lambda e: F.struct(
                e["key"].alias("column"), e["value"].alias("number"), F.lit(None).cast("string").alias("text")
            ),
        )
        where = F.transform(
            F.map_entries("affected"),
            lambda e: F.struct(
                F.concat(F.lit("affected."), e["key"]).alias("column"),
                F.lit(None).cast("double").alias("number"),
                e["value"].cast("string").alias("text"),
            ),
        )
        tall = items.select(*ITEM_KEYS, F.inline(F.concat(F.array(*texts), numbers, F.coalesce(where, F.array()))))
        return tall.select(*ITEM_KEYS, "column", F.struct("number", "text").alias(side))

    joined = facts(left, "a").join(facts(right, "b"), [*ITEM_KEYS, "column"], "full")
    a, b = F.col("a.number"), F.col("b.number")
    allowed = F.greatest(
        F.lit(RELATIVE) * F.greatest(F.abs(a), F.abs(b)),
        F.coalesce(steps[F.col("column")], F.lit(0.0)) * STEP_MARGIN + ABSOLUTE,
    )
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    number_same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= allowed)
    same = paired & number_same & F.col("a.text").eqNullSafe(F.col("b.text"))
    shown = [F.coalesce(F.col(f"{s}.text"), F.col(f"{s}.number").cast("string")).alias(s) for s in ("a", "b")]
    # Every item has a severity: its cell stands for an item on one side only.
    missing = ~paired & (F.col("column") == "severity")
    return joined.filter(~same & (paired | missing)).select(
        *ITEM_KEYS, F.when(missing, "(row)").otherwise(F.col("column")).alias("column"), *shown
    )


def item_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Items compared, items on one side only and differing facts."""
    return counted(left, item_differences(left, right))


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows compared, rows on one side only and differing cells."""
    return counted(left, differences(left, right, keys))


def counted(left: DataFrame, found: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    rows = left.agg(F.count(F.lit(1)).alias("rows")).select("rows", zero.alias("one_sided"), zero.alias("cells"))
    wrong = found.agg(
        F.count_if(F.col("column") == "(row)").alias("one_sided"),
        F.count_if(F.col("column") != "(row)").alias("cells"),
    )
    return (
        rows.unionByName(wrong.withColumn("rows", zero))
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("one_sided").alias("one_sided_rows"),
            F.sum("cells").alias("differing_cells"),
        )
    )
