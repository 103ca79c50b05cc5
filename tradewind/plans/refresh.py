"""The daily refresh: landed files to stored history.

    python -m tradewind.plans.refresh --landing DIR --run-date 2026-09-21 --store DIR

Reads one landed run, replaces the raw tables with it if they hold what was delivered, stages,
computes every as-of date and writes the history. Each step is a Spark job over
whole tables; the driver sees a digest per table and two dates.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging
from ..operators.digest import Digest
from ..operators.periods import resolve_anchors
from ..sources import schemas, storage
from .history import History, build_history, open_history, write_history
from .increment import update_history
from .lens import Lens, Settings, Tables, load_lenses, load_settings
from .session import session

WINDOW_DAYS = 30
# Manifest keys of the tables' digests.
DELIVERED = "delivered."


def run_schemas(lenses: Sequence[Lens]) -> dict[str, schemas.T.StructType]:
    """Core tables and the extra tables of `lenses`, by name."""
    extra = {source.name: source.schema for lens in lenses for source in lens.data_sources}
    clash = sorted(set(extra) & set(schemas.CORE_TABLES))
    if clash:
        raise ValueError(f"tables already exist: {clash}")
    return {**schemas.CORE_TABLES, **extra}


def land(tables: Tables, landing: str, run_date: dt.date, facts: Mapping[str, object] | None = None) -> None:
    """Files a run, then what it was made from and the digest of each table."""
    delivered = {}
    for name, frame in tables.items():
        for part, value in storage.land_run(frame, landing, name, run_date)._asdict().items():
            delivered[f"{DELIVERED}{name}.{part}"] = value
    spark = next(iter(tables.values())).sparkSession
    storage.write_manifest(spark, landing, run_date, {"end_date": run_date, **(facts or {}), **delivered})


def delivered(spark: SparkSession, landing: str, run_date: dt.date) -> dict[str, Digest]:
    """The digests that the manifest of a run holds; a few rows."""
    facts = storage.read_manifest(spark, landing).filter(
        (F.col("run_date") == F.lit(run_date)) & F.col("key").startswith(DELIVERED)
    )
    values = {r["key"].removeprefix(DELIVERED): int(r["value"]) for r in facts.collect()}
    return {k.removesuffix(".rows"): Digest(n, values[k[:-4] + "total"], values[k[:-4] + "mixed"]) for k, n in values.items() if k.endswith(".rows")}


def load(spark: SparkSession, landing: str, run_date: dt.date, store: str, lenses: Sequence[Lens]) -> dict[str, DataFrame]:
    """Replaces the raw tables with a landed run that holds exactly what was delivered."""
    landed = {name: storage.read_run(spark, landing, name, schema, run_date) for name, schema in run_schemas(lenses).items()}
    return storage.replace_checked(landed, delivered(spark, landing, run_date), f"{store.rstrip('/')}/raw")


def current(spark: SparkSession, store: str, lenses: Sequence[Lens]) -> dict[str, DataFrame]:
    """The raw tables of the last load."""
    root = f"{store.rstrip('/')}/raw"
    return {name: storage.read_current(spark, root, name, schema) for name, schema in run_schemas(lenses).items()}


def stage(raw: Tables) -> dict[str, DataFrame]:
    """Core tables cleaned; extra tables pass through."""
    steps = {
        "orders": staging.stage_orders,
        "marketing": staging.stage_marketing,
        "inventory": staging.stage_inventory,
        "customers": staging.stage_customers,
        "skus": staging.stage_skus,
    }
    return {name: steps[name](frame) if name in steps else frame for name, frame in raw.items()}


def refresh(
    spark: SparkSession,
    landing: str,
    run_date: dt.date,
    store: str,
    settings: Settings | None = None,
    window_days: int = WINDOW_DAYS,
    spacing_days: int = 1,
    count: int | None = None,
    incremental: bool = False,
) -> History:
    """With `incremental` only the dates that the run changes are computed, where a
    history with the same settings is there."""
    settings = settings or load_settings()
    lenses = load_lenses(settings.enabled)
    path = f"{store.rstrip('/')}/history"
    before = stage(current(spark, store, lenses)) if incremental else None
    tables = stage(load(spark, landing, run_date, store, lenses))
    # Several KPI sections start from the deduplicated orders.
    tables["orders"] = storage.materialize(tables["orders"])
    anchors = resolve_anchors(
        tables["orders"], tables["marketing"], tables["inventory"], window_days, spacing_days, count
    )
    if before is not None:
        before["orders"] = storage.materialize(before["orders"])
        update_history(spark, path, before, tables, anchors, settings)
        return open_history(spark, path)
    built = build_history(spark, tables, anchors, lenses, settings, store_shared=True, by_date=True)
    write_history(built, path)
    return built


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Refresh the KPI history from one landed run.")
    parser.add_argument("--landing", required=True, help="folder with <table>/run_date=<day>")
    parser.add_argument("--run-date", required=True, type=dt.date.fromisoformat)
    parser.add_argument("--store", required=True, help="folder for raw tables and history")
    parser.add_argument("--window-days", type=int, default=WINDOW_DAYS)
    parser.add_argument("--spacing-days", type=int, default=1)
    parser.add_argument("--count", type=int, default=None, help="at most this many as-of dates")
    parser.add_argument("--incremental", action="store_true", help="compute only the dates that the run changes")
    given = parser.parse_args(arguments)
    refresh(
        session("tradewind-refresh"),
        given.landing,
        given.run_date,
        given.store,
        window_days=given.window_days,
        spacing_days=given.spacing_days,
        count=given.count,
        incremental=given.incremental,
    )


if __name__ == "__main__":
    main()
