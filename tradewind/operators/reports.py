"""Summaries and documents made from KPI rows and decision items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.prose import DEFAULT_LANGUAGE, FACTS_MARK, PROMPT_HEADER, SUMMARY, TILES, render
from .decisions import DEFAULT_TOP, Localizer, few_issues, localize, severity_counts, top_issues
from .rules import SEVERITIES

HEADLINES_IN_SUMMARY = 3
JSON_OPTIONS = {"ignoreNullFields": "false"}
SALES_KPIS = ("net_revenue", "orders", "units_sold", "aov")


def executive_summary(
    decisions: DataFrame,
    sales_summary: DataFrame,
    lang: str,
    localizers: Mapping[str, Localizer],
    counts: DataFrame | None = None,
) -> DataFrame:
    """One paragraph per as-of date: revenue change, severity counts and the
    three most material headlines. English keeps the headlines as raised.

    With `counts` (the severity counts) `decisions` may be the few that
    `few_issues` stored, and several languages start from one pass."""
    words = SUMMARY.get(lang, SUMMARY["en"])
    top = top_issues(decisions, HEADLINES_IN_SUMMARY)
    if lang == "ko":
        top = localize(top, lang, localizers)
    # At most three rows per date reach this list.
    headlines = top.groupBy("as_of").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "headline"))), lambda s: s["headline"]), "; "
        ).alias("_headlines")
    )
    if counts is None:
        counts = severity_counts(decisions, sales_summary)
    revenue = render(words["revenue"], {"pct": text.signed_pct("pct_net_revenue")})
    counted = render(words["counts"], {s: s for s in SEVERITIES})
    listed = render(words["top"], {"headlines": "_headlines"})
    return (
        sales_summary.select("as_of", "pct_net_revenue")
        .join(counts, "as_of")
        .join(headlines, "as_of", "left")
        .select("as_of", F.expr(f"concat_ws(' ', {revenue}, {counted}, {listed})").alias("summary"))
    )


def _tiles(frame: DataFrame, lang: str, tiles: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per tile from the SQL of its value and delta."""
    rows = []
    for key, (value, delta) in tiles.items():
        label = TILES[key].get(lang, TILES[key][DEFAULT_LANGUAGE])
        rows.append(
            f"struct({text.quoted(key)} as tile, {text.quoted(label)} as label, {value} as value, {delta} as delta)"
        )
    return frame.select("as_of", F.expr(f"inline(array({', '.join(rows)}))"))


def sales_tiles(summary: DataFrame, lang: str) -> DataFrame:
    return _tiles(
        summary,
        lang,
        {
            "net_revenue": (text.currency("current_net_revenue"), text.signed_pct("pct_net_revenue")),
            "orders": ("string(current_orders)", text.signed_pct("pct_orders")),
            "aov": (text.currency("current_aov"), text.signed_pct("pct_aov")),
        },
    )


def customer_tiles(mix: DataFrame, lang: str) -> DataFrame:
    """New-customer share; the delta is in percentage points, NULL where one
    of the shares is missing."""
    points = text.signed("((current_new_share - previous_new_share) * 100)", 1)
    value = text.or_not_available(text.share("current_new_share"))
    return _tiles(mix, lang, {"new_share": (value, f"concat({points}, 'pt')")})


def period_struct() -> Column:
    bounds = ("current_start", "current_end", "previous_start", "previous_end")
    return F.struct(*(F.date_format(b, "yyyy-MM-dd").alias(b) for b in bounds))


def sales_struct() -> Column:
    """The sales summary as ``{current, previous, pct_change}``."""

    def kpis(prefix: str, digits: int) -> Column:
        fields = []
        for kpi in SALES_KPIS:
            value = F.col(f"{prefix}_{kpi}")
            counted = kpi in ("orders", "units_sold") and prefix != "pct"
            fields.append((value if counted else value.cast(f"decimal(28,{digits})")).alias(kpi))
        return F.struct(*fields)

    return F.struct(
        kpis("current", 2).alias("current"), kpis("previous", 2).alias("previous"), kpis("pct", 1).alias("pct_change")
    )


def item_struct(*columns: str) -> Column:
    def field(name: str) -> Column:
        if name == "supporting_kpi":
            return F.transform_values(name, lambda _, v: v.cast("decimal(28,3)")).alias(name)
        return F.col(name)

    return F.struct(*(field(c) for c in columns))


def fact_lines(decisions: DataFrame, sales_summary: DataFrame, periods: DataFrame) -> DataFrame:
    """The grounded facts of each as-of date as JSON lines: the period, the
    sales summary, and one line per decision item, never raw rows.

    Lines, not one document: the number of items per date has no bound, and a
    reader can take them in order of ``severity`` without gathering a date in
    one place.
    """
    document = ("issue_type", "headline", "severity", "supporting_kpi", "likely_drivers", "affected")
    document += ("possible_action", "kpi_to_monitor", "lens")

    def line(kind: str, body: Column) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.to_json(body, JSON_OPTIONS).alias("fact")]

    return (
        periods.select("as_of", *line("period", period_struct()))
        .unionByName(sales_summary.select("as_of", *line("sales_summary", sales_struct())))
        .unionByName(decisions.select("as_of", *line("decision", item_struct(*document))))
    )


def copy_prompt(
    decisions: DataFrame,
    sales_summary: DataFrame,
    periods: DataFrame,
    lang: str,
    localizers: Mapping[str, Localizer],
    n: int = DEFAULT_TOP,
) -> DataFrame:
    """Per as-of date a self-contained prompt: instructions, then the period,
    the sales summary and the `n` most material items as JSON."""
    fields = ("headline", "severity", "supporting_kpi", "likely_drivers", "possible_action", "kpi_to_monitor")
    top = localize(top_issues(few_issues(decisions, n), n), lang, localizers)
    # At most n rows per date reach this list.
    issues = top.groupBy("as_of").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("rank", F.to_json(item_struct(*fields), JSON_OPTIONS).alias("item")))
            ),
            lambda s: s["item"],
        ).alias("_issues")
    )
    facts = F.concat(
        F.lit('{"as_of_date":"'),
        F.date_format("as_of", "yyyy-MM-dd"),
        F.lit('","period":'),
        F.to_json(period_struct(), JSON_OPTIONS),
        F.lit(',"sales_summary":'),
        F.to_json(sales_struct(), JSON_OPTIONS),
        F.lit(',"issues":['),
        F.coalesce(F.array_join("_issues", ","), F.lit("")),
        F.lit("]}"),
    )
    header = PROMPT_HEADER.get(lang, PROMPT_HEADER[DEFAULT_LANGUAGE])
    return (
        periods.join(sales_summary, "as_of")
        .join(issues, "as_of", "left")
        .select("as_of", F.concat(F.lit(header), F.lit(FACTS_MARK), facts).alias("prompt"))
    )


def param_diff(base: DataFrame, changed: DataFrame) -> DataFrame:
    """Parameters ``lens, key, value`` whose value differs, as ``base → value``."""
    renamed = changed.withColumnRenamed("value", "changed")
    return (
        base.join(renamed, ["lens", "key"])
        .filter(F.col("value") != F.col("changed"))
        .select(
            "lens",
            "key",
            F.concat(_general(F.col("value")), F.lit(" → "), _general(F.col("changed"))).alias("change"),
        )
    )


def _general(value: Column) -> Column:
    """Shortest text: no trailing zeros, no decimal point on whole numbers."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(20,6)").cast("string"), r"0+$", ""), r"\.$", "")
