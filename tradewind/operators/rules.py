"""Threshold rules: KPI rows in, decision items out.

A rule reads KPI rows only, never raw data, and its thresholds are Columns:
literals for a normal run, scenario fields for a threshold sweep. Items of
one KPI row stay in the task of that row; no rule shuffles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import round_half_even
from ..functions.prose import RAISED, render
from .inventory import risk_flags

# Severities, most severe first.
SEVERITIES = ("high", "medium", "low")

IMPACT = "estimated_revenue_impact"

Thresholds = Mapping[str, Column]


def literals(params: Mapping[str, float]) -> dict[str, Column]:
    return {key: F.lit(float(value)) for key, value in params.items()}


def sql_map(entries: Mapping[str, str], value_type: str) -> str:
    """SQL of a map from names to the SQL of their values."""
    pairs = ", ".join(f"{text.quoted(k)}, cast({v} as {value_type})" for k, v in entries.items())
    return f"cast(map({pairs}) as map<string, {value_type}>)"


def items(
    rows: DataFrame,
    by: Sequence[str],
    issue_type: Column,
    severity: Column,
    kpi: Mapping[str, str],
    impact: str,
    affected: Mapping[str, str],
    texts: Mapping[str, str],
    order_value: str,
    order_key: Sequence[str] = (),
) -> DataFrame:
    """Decision items in the common shape. Facts and texts are SQL over the
    columns of `rows`."""
    key = ", ".join(f"string({k})" for k in order_key)
    return rows.select(
        *by,
        issue_type.alias("issue_type"),
        severity.alias("severity"),
        *(
            F.expr(sql).alias(name)
            for name, sql in {
                "headline": texts["headline"],
                "supporting_kpi": sql_map({**kpi, IMPACT: impact}, "double"),
                "likely_drivers": f"array({texts['driver']})",
                "affected": sql_map(affected, "string"),
                "possible_action": texts["action"],
                "kpi_to_monitor": texts["monitor"],
                "order_value": f"double({order_value})",
                "order_key": f"cast(array({key}) as array<string>)",
            }.items()
        ),
    )


def raised_texts(issue_type: str, facts: Mapping[str, str]) -> dict[str, str]:
    return {part: render(words, facts) for part, words in RAISED[issue_type].items()}


def columns(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def detect_sales_decline(segments: DataFrame, params: Thresholds, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """Revenue of a brand and channel fell; judged on the rounded change."""
    pct = F.col("pct_change")
    fired = segments.filter(
        (F.col("previous_net_revenue") >= params["min_segment_previous_revenue"])
        & (pct <= params["decline_medium_pct"])
    )
    where = columns("brand", "channel")
    facts = {
        "previous": text.fixed("previous_net_revenue"),
        "current": text.fixed("current_net_revenue"),
        "pct": text.fixed("pct_change", 1),
    }
    return items(
        fired,
        by,
        F.lit("sales_decline"),
        F.when(pct <= params["decline_high_pct"], "high").otherwise("medium"),
        kpi={
            "current_net_revenue": round_half_even("current_net_revenue", 2),
            "previous_net_revenue": round_half_even("previous_net_revenue", 2),
            "pct_change": round_half_even("pct_change", 1),
        },
        impact="change",
        affected=where,
        texts=raised_texts("sales_decline", {**where, **facts}),
        order_value="-abs(change)",
        order_key=list(where),
    )


def detect_marketing_decline(segments: DataFrame, params: Thresholds, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """ROAS of a brand and marketing channel fell; judged on the unrounded
    change. The impact is what the spend would have earned at the old ROAS."""
    change = "(try_divide(current_roas - previous_roas, previous_roas) * 100)"
    pct = F.expr(change)
    fired = segments.filter(
        (F.col("previous_spend") >= params["min_segment_spend"]) & (pct <= params["decline_medium_pct"])
    )
    where = columns("brand", "marketing_channel")
    facts = {
        "previous_spend": text.fixed("previous_spend"),
        "current_spend": text.fixed("current_spend"),
        "previous_revenue": text.fixed("previous_attributed_revenue"),
        "current_revenue": text.fixed("current_attributed_revenue"),
    }
    return items(
        fired,
        by,
        F.lit("marketing_efficiency_decline"),
        F.when(pct <= params["decline_high_pct"], "high").otherwise("medium"),
        kpi={
            "current_roas": round_half_even("current_roas", 2),
            "previous_roas": round_half_even("previous_roas", 2),
            "roas_change_pct": round_half_even(change, 1),
            "current_spend": round_half_even("current_spend", 2),
        },
        impact=round_half_even("(current_attributed_revenue - current_spend * previous_roas)", 2),
        affected=where,
        texts=raised_texts("marketing_efficiency_decline", {**where, **facts}),
        order_value="roas_change_pct",
        order_key=list(where),
    )


def detect_inventory_issues(risk: DataFrame, params: Thresholds, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """Stock-out or excess risk per SKU; a stock-out hides an excess. Flags are
    taken anew from the stored position under the given limits."""
    flagged = risk.withColumns(risk_flags(params["stockout_days"], params["excess_days"])).filter(
        "stockout_risk or excess_risk"
    )
    short = F.col("stockout_risk")
    facts = {
        **columns("brand", "sku_id", "on_hand"),
        "velocity": text.fixed("velocity", 1),
        "cover": text.fixed("days_of_cover", 1),
    }
    out, over = raised_texts("stockout_risk", facts), raised_texts("excess_inventory_risk", facts)
    return items(
        flagged,
        by,
        F.when(short, "stockout_risk").otherwise("excess_inventory_risk"),
        F.when(~short, "low")
        .when(F.col("days_of_cover") < params["high_severity_days"], "high")
        .otherwise("medium"),
        kpi={
            "on_hand": "on_hand",
            "velocity_per_day": round_half_even("velocity", 2),
            "days_of_cover": round_half_even("days_of_cover", 1),
        },
        impact="null",
        affected=columns("brand", "sku_id"),
        texts={part: f"if(stockout_risk, {out[part]}, {over[part]})" for part in out},
        order_value="days_of_cover",
        order_key=["sku_id"],
    )


def detect_customer_mix(mix: DataFrame, params: Thresholds, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """The new-customer share fell; judged on the unrounded change of the
    rounded shares. At most one item per as-of date."""
    change = "(try_divide(current_new_share - previous_new_share, previous_new_share) * 100)"
    pct = F.expr(change)
    facts = {"previous": text.share("previous_new_share"), "current": text.share("current_new_share")}
    return items(
        mix.filter(pct <= params["new_share_drop_medium_pct"]),
        by,
        F.lit("customer_mix_shift"),
        F.when(pct <= params["new_share_drop_high_pct"], "high").otherwise("medium"),
        kpi={
            **columns("current_new_share", "previous_new_share"),
            "pct_change": round_half_even(change, 1),
        },
        impact="null",
        affected={},
        texts=raised_texts("customer_mix_shift", facts),
        order_value="0",
    )


def severity_rank() -> Column:
    """0 for the most severe; anything unknown comes last."""
    names = ", ".join(text.quoted(s) for s in SEVERITIES)
    return F.expr(f"coalesce(nullif(array_position(array({names}), severity), 0) - 1, 99)")


def stamped(item_rows: DataFrame, lens: str, position: int) -> DataFrame:
    """Items with the viewpoint that raised them and its place in the order."""
    return item_rows.withColumns({"lens": F.lit(lens), "lens_order": F.lit(position)})


def by_severity() -> list[Column]:
    """Report order: severity, then viewpoint order, then section order."""
    return [severity_rank().asc(), *standing()]


def standing() -> list[Column]:
    return [F.col("lens_order").asc(), F.col("order_value").asc_nulls_first(), F.col("order_key").asc()]


def resolution_between(items: DataFrame, earlier: dt.date, later: dt.date) -> DataFrame:
    """`resolution` of two as-of dates of one frame, in one pass over it."""

    def severity(day: dt.date) -> Column:
        # Of several items of an issue, the gravest.
        rank = F.min(F.when(F.col("as_of") == F.lit(day), severity_rank()))
        return F.get(F.array(*(F.lit(s) for s in SEVERITIES)), rank.cast("int"))

    sides = items.filter(F.col("as_of").isin(earlier, later)).groupBy("lens", "issue_type", "kpi_to_monitor")
    return _with_status(sides.agg(severity(earlier).alias("severity_before"), severity(later).alias("severity_after")))


def resolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each issue between two sets of items.

    An issue is the same if viewpoint, type and watched KPI agree. One full
    outer join answers all three questions: gone, still there, new.
    """
    same = ["lens", "issue_type", "kpi_to_monitor"]

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*same, F.col("severity").alias(f"severity_{name}"))

    return _with_status(side(before, "before").join(side(after, "after"), same, "full"))


def _with_status(joined: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("severity_after").isNull(), "resolved")
        .when(F.col("severity_before").isNull(), "new")
        .otherwise("persisting")
    )
    return joined.withColumn("status", status)


def lifetimes(items: DataFrame, anchors: Anchors) -> DataFrame:
    """Every run of successive as-of dates on which an issue is raised: ``first_seen``,
    ``last_seen``, ``dates``, its ``gravest`` severity, ``occurrence`` (from 1) of
    ``occurrences`` of the issue, and ``open``: whether it lasts to the latest date.

    Gaps and islands: within an issue the position of a date less its rank is the
    same throughout a run. An issue has one row per as-of date at most.
    """
    same = ["lens", "issue_type", "kpi_to_monitor"]
    order = Window.partitionBy(*same).orderBy("_at")
    daily = items.groupBy(*same, anchors.index_from(F.col("as_of")).alias("_at")).agg(F.min(severity_rank()).alias("_rank"))
    runs = (
        daily.withColumn("_run", F.col("_at") - F.row_number().over(order))
        .groupBy(*same, "_run")
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min("_rank").alias("_rank"))
    )
    whole = Window.partitionBy(*same)
    return runs.select(
        *same,
        anchors.date_at(F.col("_first")).alias("first_seen"),
        anchors.date_at(F.col("_last")).alias("last_seen"),
        (F.col("_last") - F.col("_first") + 1).alias("dates"),
        F.get(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("_rank").cast("int")).alias("gravest"),
        F.row_number().over(whole.orderBy("_first")).alias("occurrence"),
        F.count(F.lit(1)).over(whole).alias("occurrences"),
        (F.col("_last") == len(anchors.dates) - 1).alias("open"),
    )
