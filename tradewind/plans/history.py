"""KPIs and decision items for all as-of dates in one run.

A history is a set of lazy frames keyed by ``as_of``: one per KPI section, one
for the items, one header row per date. It is stored as one JSON table per
frame, partitioned by date, so neither writing nor reading ever gathers a
date's rows in one place.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import rules
from ..operators.decisions import kpi_trend, localize, tag_lens
from ..operators.periods import Anchors
from ..sources.storage import materialize, read_existing
from .lens import Lens, Settings, Tables, issue_owners, load_lens, load_lenses, localizers, resolve_params

# Fixed value: version of the stored layout.
SCHEMA_VERSION = 2
# Where a stored history describes its frames.
SCHEMAS = "_schemas"
ENGINE = "spark"


@dataclass
class History:
    lenses: Sequence[Lens]
    params: Mapping[str, Mapping[str, float]]
    header: DataFrame
    sections: Mapping[str, Mapping[str, DataFrame]]
    decisions: DataFrame
    # Frames whose rows lie together by date, as they were stored that way or come from such.
    by_date: frozenset[str] = frozenset()

    def frames(self) -> dict[str, DataFrame]:
        """Every stored frame by name."""
        named = {
            f"{lens}.{name}": frame for lens, parts in self.sections.items() for name, frame in parts.items()
        }
        return {"header": self.header, **named, "decisions": self.decisions}


def compute_sections(
    lenses: Sequence[Lens], tables: Tables, anchors: Anchors, overrides: Mapping[str, Mapping[str, float]]
) -> tuple[dict[str, dict[str, DataFrame]], dict[str, dict[str, float]]]:
    """KPI frames and resolved parameters, both by lens id."""
    params = {lens.id: resolve_params(lens, overrides.get(lens.id)) for lens in lenses}
    return {lens.id: lens.compute(tables, anchors, params[lens.id]) for lens in lenses}, params


def run_detection(
    lenses: Sequence[Lens],
    sections: Mapping[str, Mapping[str, DataFrame]],
    params: Mapping[str, Mapping[str, float]],
) -> DataFrame:
    """Items of all lenses, each with its lens. Order with `rules.by_severity`."""
    found = [
        rules.stamped(
            lens.detect(sections[lens.id], rules.literals(resolve_params(lens, params.get(lens.id))), ("as_of",)),
            lens.id,
            position,
        )
        for position, lens in enumerate(lenses)
    ]
    return reduce(DataFrame.unionByName, found)


def sweep(
    lenses: Sequence[Lens],
    sections: Mapping[str, Mapping[str, DataFrame]],
    params: Mapping[str, Mapping[str, float]],
    scenarios: Mapping[str, Mapping[str, Mapping[str, float]]],
) -> DataFrame:
    """Items under several sets of thresholds, from stored KPIs only.

    Each KPI row is read once and carries the few scenarios as an exploded
    literal array; no join, no second pass. Only runtime parameters may differ.
    """
    found = []
    for position, lens in enumerate(lenses):
        keys = lens.runtime_keys()
        rows = []
        for name, overrides in scenarios.items():
            changed = overrides.get(lens.id, {})
            fixed = sorted(set(changed) - set(keys))
            if fixed:
                raise ValueError(f"parameters {fixed} of lens '{lens.id}' need a new computation")
            values = resolve_params(lens, {**params.get(lens.id, {}), **changed})
            rows.append(F.struct(F.lit(name).alias("scenario"), *(F.lit(float(values[k])).alias(k) for k in keys)))
        spread = {
            n: f.withColumn("_scenario", F.explode(F.array(*rows))).withColumn("scenario", F.col("_scenario.scenario"))
            for n, f in sections[lens.id].items()
        }
        thresholds = {k: F.col(f"_scenario.{k}") for k in keys}
        by = ("scenario", "as_of")
        found.append(rules.stamped(lens.detect(spread, thresholds, by), lens.id, position))
    return reduce(DataFrame.unionByName, found)


def header_frame(
    spark: SparkSession, anchors: Anchors, lenses: Sequence[Lens], params: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """One row per as-of date: versions, period bounds, lenses, engine per
    lens, parameters; the narrative is filled in by others."""
    ids = [text.quoted(lens.id) for lens in lenses]
    values = [rules.sql_map({k: repr(float(v)) for k, v in params[lens.id].items()}, "double") for lens in lenses]
    return anchors.frame(spark).select(
        "as_of",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct("current_start", "current_end", "previous_start", "previous_end").alias("period"),
        F.expr(f"array({', '.join(ids)})").alias("lenses"),
        F.expr(f"map({', '.join(f'{i}, {text.quoted(ENGINE)}' for i in ids)})").alias("metrics_source"),
        F.expr(f"map({', '.join(f'{i}, {v}' for i, v in zip(ids, values))})").alias("params"),
        F.lit(None).cast("string").alias("narrative"),
    )


def build_history(
    spark: SparkSession,
    tables: Tables,
    anchors: Anchors,
    lenses: Sequence[Lens] | None = None,
    settings: Settings | None = None,
    store_shared: bool = False,
    by_date: bool = False,
) -> History:
    """All lenses for all as-of dates. With `store_shared` the sections that
    rules and reports share are written once to the shared folder first, so
    detection, reports and trends start from stored rows. With `by_date` they are
    shuffled by date on the way, which a history that is to be written needs."""
    settings = settings or Settings()
    chosen = list(lenses) if lenses is not None else load_lenses(settings.enabled)
    sections, params = compute_sections(chosen, tables, anchors, settings.params)
    if store_shared:
        for lens in chosen:
            placed = _by_date if by_date else lambda frame: frame
            sections[lens.id].update({n: materialize(placed(sections[lens.id][n])) for n in lens.shared})
    shared = {f"{lens.id}.{n}" for lens in chosen for n in lens.shared}
    return History(
        lenses=chosen,
        params=params,
        header=header_frame(spark, anchors, chosen, params),
        sections=sections,
        decisions=run_detection(chosen, sections, params),
        by_date=frozenset(shared | {"decisions"}) if store_shared and by_date else frozenset(),
    )


def trend(history: History, decisions: DataFrame) -> DataFrame:
    """The watched KPI of each of `decisions` over the whole history."""
    tagged = tag_lens(decisions, issue_owners())
    points, series = [], F.lit(None).cast("array<string>")
    for lens in history.lenses:
        if lens.trend is None or lens.series is None:
            continue
        points.append(lens.trend(history.sections[lens.id]).withColumn("lens", F.lit(lens.id)))
        series = F.when(F.col("lens") == lens.id, lens.series(F.col("affected"))).otherwise(series)
    return kpi_trend(tagged.withColumn("series", series), reduce(DataFrame.unionByName, points))


def available_dates(header: DataFrame) -> DataFrame:
    """The stored as-of dates, the latest one marked."""
    latest = header.agg(F.max("as_of").alias("_latest")).scalar()
    return header.select("as_of", (F.col("as_of") == latest).alias("is_latest"))


def tiles(history: History, lang: str) -> DataFrame:
    """Headline tiles of every lens that has some, per as-of date."""
    shown = [
        lens.headline_metrics(history.sections[lens.id], lang)
        for lens in history.lenses
        if lens.headline_metrics is not None
    ]
    return reduce(DataFrame.unionByName, shown)


def localized(decisions: DataFrame, lang: str) -> DataFrame:
    return localize(decisions, lang, localizers())


def cells(frame: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Every value of a dated frame as a row: as_of, frame, key (the key columns'
    values), column, and the value as a number (flags as 0 and 1) or as a text."""

    def cell(field: T.StructField) -> Column:
        worded = isinstance(field.dataType, T.StringType)
        nothing = F.lit(None)
        return F.struct(
            F.lit(field.name).alias("column"),
            (nothing.cast("double") if worded else F.col(field.name).cast("double")).alias("number"),
            (F.col(field.name) if worded else nothing.cast("string")).alias("text"),
        )

    values = [f for f in frame.schema.fields if f.name not in ("as_of", *keys)]
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return frame.select(
        "as_of", F.lit(name).alias("frame"), key.alias("key"), F.inline(F.array(*map(cell, values)))
    )


def write_history(history: History, path: str) -> None:
    """One JSON table per frame, partitioned by as-of date; NULLs are kept.

    The rebalance hint lets Spark put small dates together and split large
    ones, so the number of files follows the data and not the task count; items follow
    their stored sections, so that their texts are never shuffled. Files are
    compressed: every row repeats the names of its fields.
    """
    frames = history.frames()
    described = [(name, frame.schema.json()) for name, frame in frames.items()]
    schemas = history.header.sparkSession.createDataFrame(described, "frame STRING, schema STRING")
    schemas.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{SCHEMAS}")
    for name, frame in frames.items():
        _write_frame(frame, f"{path.rstrip('/')}/{name}", "overwrite", name in history.by_date)


def append_history(history: History, path: str) -> None:
    """Adds the dates of `history`, header last; frames without dates are replaced."""
    frames = history.frames()
    for name in sorted(frames, key=lambda n: n == "header"):
        mode = "append" if "as_of" in frames[name].columns else "overwrite"
        _write_frame(frames[name], f"{path.rstrip('/')}/{name}", mode, name in history.by_date)


def _by_date(frame: DataFrame) -> DataFrame:
    return frame.hint("rebalance", "as_of") if "as_of" in frame.columns else frame


def _write_frame(frame: DataFrame, target: str, mode: str, by_date: bool) -> None:
    dated = "as_of" in frame.columns
    writer = (frame if by_date else _by_date(frame)).write.mode(mode)
    writer = writer.option("ignoreNullFields", "false").option("compression", "gzip")
    (writer.partitionBy("as_of") if dated else writer).json(target)


def read_frame(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """One frame of a stored history; a missing one is a clear error."""
    return read_existing(spark.read.schema(schema), f"{path.rstrip('/')}/{name}", f"history frame '{name}'")


def open_history(spark: SparkSession, path: str) -> History:
    """A stored history by itself: frames, and the lenses and parameters that its
    header recorded. Lenses of others must be registered before.

    The driver reads one row per frame and the latest header row.
    """
    known = read_frame(spark, path, SCHEMAS, T.StructType.fromDDL("frame STRING, schema STRING")).collect()
    schemas = {r["frame"]: T.StructType.fromJson(json.loads(r["schema"])) for r in known}
    stored = {name: read_frame(spark, path, name, schema).select(*schema.names) for name, schema in schemas.items()}
    head = stored["header"].orderBy(F.desc("as_of")).first()
    if head is None:
        raise ValueError(f"the history at {path} has no as-of date")
    sections: dict[str, dict[str, DataFrame]] = {lens: {} for lens in head["lenses"]}
    for name, frame in stored.items():
        lens, dot, part = name.partition(".")
        if dot:
            sections[lens][part] = frame
    return History(
        lenses=[load_lens(name) for name in head["lenses"]],
        params={lens: dict(values) for lens, values in head["params"].items()},
        header=stored["header"],
        sections=sections,
        decisions=stored["decisions"],
    )
