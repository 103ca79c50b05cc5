"""Reading decision items: counts, ranking, filters, trends, language."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prose import LANGUAGES, LOCALIZED, render
from ..functions import text
from ..sources.storage import materialize
from .ranking import positions
from .rules import IMPACT, SEVERITIES, severity_rank, standing

DEFAULT_TOP = 5


def severity_counts(decisions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Items per severity for every as-of date, 0 where there are none."""
    counted = decisions.groupBy("as_of").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES)
    )
    zero = F.lit(0).cast("bigint")
    return anchors.select("as_of").join(counted, "as_of", "left").select(
        "as_of", *(F.coalesce(s, zero).alias(s) for s in SEVERITIES)
    )


def impact() -> Column:
    return F.col("supporting_kpi")[IMPACT]


def by_materiality() -> list[Column]:
    """Severity first, then size of the impact; no estimate comes last."""
    return [severity_rank().asc(), F.abs(impact()).desc_nulls_last(), *standing()]


def top_issues(decisions: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """The `n` most material items per as-of date, with their ``rank``.

    Planned as a group limit ahead of the shuffle: a task passes on at most
    `n` items per date.
    """
    window = Window.partitionBy("as_of").orderBy(*by_materiality())
    return decisions.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def few_issues(decisions: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """The items of the issues in `top_issues`, with their texts, stored.

    Items are ranked by what orders them first, so that no task sorts texts; the
    names of the issues, `n` per as-of date, then pick the items."""
    same = ["as_of", "lens", "issue_type", "kpi_to_monitor"]
    ordered = decisions.select(
        *same, "severity", "lens_order", "order_value", "order_key", F.create_map(F.lit(IMPACT), impact()).alias("supporting_kpi")
    )
    names = materialize(top_issues(ordered, n).select(*(F.col(c).alias(f"_{c}") for c in same)))
    own = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
    return materialize(decisions.join(names, own, "left_semi"))


def ranked_issues(decisions: DataFrame) -> DataFrame:
    """All items with their ``rank`` per as-of date, however many a date has."""
    return positions(decisions, by_materiality(), ["as_of"], "rank")


def _chosen(lenses: Sequence[str], severities: Sequence[str], owners: Mapping[str, str]) -> Column:
    """Whether an item is chosen; one without a known lens goes by its issue type."""
    chosen = F.lit(True)
    if lenses:
        chosen = chosen & F.coalesce(_owner(owners).isin(*lenses), F.lit(False))
    if severities:
        chosen = chosen & F.col("severity").isin(*severities)
    return chosen


def filter_decisions(
    decisions: DataFrame,
    lenses: Sequence[str] = (),
    severities: Sequence[str] = (),
    owners: Mapping[str, str] = MappingProxyType({}),
) -> DataFrame:
    """Items of the chosen viewpoints and severities; no choice means all.
    `owners` (issue type to lens) places items that carry no lens."""
    return decisions.filter(_chosen(lenses, severities, owners))


def shown_and_total(
    decisions: DataFrame,
    lenses: Sequence[str] = (),
    severities: Sequence[str] = (),
    owners: Mapping[str, str] = MappingProxyType({}),
) -> DataFrame:
    """How many items a filter shows, of how many, per as-of date."""
    chosen = _chosen(lenses, severities, owners)
    return decisions.groupBy("as_of").agg(F.count_if(chosen).alias("shown"), F.count(F.lit(1)).alias("total"))


def _owner(owners: Mapping[str, str]) -> Column:
    owner = F.lit(None).cast("string")
    for issue_type, lens in owners.items():
        owner = F.when(F.col("issue_type") == issue_type, lens).otherwise(owner)
    known = F.when(F.col("lens").isin(*set(owners.values())), F.col("lens")) if owners else F.lit(None)
    return F.coalesce(known, owner, F.col("lens"))


def tag_lens(decisions: DataFrame, owners: Mapping[str, str]) -> DataFrame:
    """Fills a missing ``lens`` from the issue type (items of older files)."""
    return decisions.withColumn("lens", _owner(owners))


def kpi_trend(decisions: DataFrame, points: DataFrame) -> DataFrame:
    """The watched KPI of each item at every as-of date that has a value.

    `points` is the tall KPI history ``lens, series, as_of, value``; items
    carry the same ``series``. An equi-join, one point per date and series.
    """
    issue = decisions.select("lens", "series", "issue_type", "kpi_to_monitor").distinct()
    known = points.filter(F.col("value").isNotNull())
    return issue.join(known, ["lens", "series"]).select("lens", "issue_type", "kpi_to_monitor", "as_of", "value")


# Gives, for a language, the texts to replace as SQL over the item's columns.
Localizer = Callable[[str], Mapping[str, str]]


def _facts(issue_type: str) -> dict[str, str]:
    def kpi(name: str) -> str:
        return f"supporting_kpi['{name}']"

    names = {n: f"affected['{n}']" for n in ("brand", "channel", "marketing_channel", "sku_id")}
    if issue_type == "sales_decline":
        return names | {
            "previous": text.number(kpi("previous_net_revenue")),
            "current": text.number(kpi("current_net_revenue")),
            "pct": text.signed_pct(kpi("pct_change")),
        }
    if issue_type == "marketing_efficiency_decline":
        return names | {
            "previous": text.fixed(kpi("previous_roas"), 2),
            "current": text.fixed(kpi("current_roas"), 2),
            "pct": text.signed_pct(kpi("roas_change_pct")),
            "spend": text.number(kpi("current_spend")),
        }
    if issue_type == "customer_mix_shift":
        return names | {"previous": text.share(kpi("previous_new_share")), "current": text.share(kpi("current_new_share"))}
    return names | {
        "velocity": text.fixed(kpi("velocity_per_day"), 1),
        "on_hand": f"bigint({kpi('on_hand')})",
        "cover": text.fixed(kpi("days_of_cover"), 1),
    }


def builtin_localizer(issue_type: str) -> Localizer:
    """Headline, drivers and action of a built-in issue type, rebuilt from the
    facts on the item."""

    def localize_one(lang: str) -> dict[str, str]:
        words = LOCALIZED[issue_type][lang]
        facts = _facts(issue_type)
        return {
            "headline": render(words["headline"], facts),
            "likely_drivers": f"array({render(words['driver'], facts)})",
            "possible_action": render(words["action"], facts),
        }

    return localize_one


def localize(decisions: DataFrame, lang: str, localizers: Mapping[str, Localizer]) -> DataFrame:
    """Prose in `lang`. An unknown language, or an issue type without a
    localizer, keeps the text the item was raised with."""
    if lang not in LANGUAGES:
        return decisions
    cases: dict[str, list[str]] = {}
    for issue_type, localizer in localizers.items():
        for column, words in localizer(lang).items():
            cases.setdefault(column, []).append(f"when {text.quoted(issue_type)} then {words}")
    prose = {c: F.expr(f"case issue_type {' '.join(whens)} else {c} end") for c, whens in cases.items()}
    return decisions.withColumns(prose)
