"""A stored history brought up to date: only the dates that a change reaches.

A day whose rows changed enters the periods of the as-of dates up to two windows
later. Days are compared by digest, so neither side is sorted or joined row by
row, and the dates that no changed day reaches keep their files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest
from ..operators.periods import Anchors
from . import history as H
from .lens import Lens, Settings, Tables, load_lenses, resolve_params

# The day by which a table's rows enter dated KPIs, and the columns
# that dated KPIs read where that isn't all of them.
DAY_OF = {
    "orders": "order_date",
    "order_heads": "order_date",
    "marketing": "date",
    "inventory": "date",
    "acquired": "first_order_date",
    "customers": "first_order_date",
}
READ = {"customers": ("customer_id", "acquisition_channel", "first_order_date")}
# Tables whose content no KPI reads.
UNREAD = frozenset(("skus",))


def changed_days(before: DataFrame, after: DataFrame, day: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The days on which two tables don't hold the same rows."""
    columns = list(columns or after.columns)
    sides = [
        side.groupBy(F.col(day).alias("day")).agg(F.struct(*digest.measures(columns)).alias(name))
        for side, name in ((before, "a"), (after, "b"))
    ]
    return sides[0].join(sides[1], "day", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("day")


def _reached(days: Sequence[dt.date], anchors: Anchors, reach: int) -> set[dt.date]:
    """As-of dates with one of the days among the `reach` days that end on them."""
    found = {d + dt.timedelta(days=i) for d in days for i in range(reach)}
    return found & set(anchors.dates)


def dates_to_compute(before: Tables, after: Tables, anchors: Anchors, stored: Sequence[dt.date], reach: int) -> list[dt.date]:
    """As-of dates that aren't stored, or that a changed day reaches; all of them
    where a table without a known day changed. The driver reads calendar days."""
    undated = [n for n in after if n not in DAY_OF and n not in UNREAD]
    if set(before) != set(after) or any(digest.digest(before[n]) != digest.digest(after[n]) for n in undated):
        return list(anchors.dates)
    parts = [changed_days(before[n], after[n], DAY_OF[n], READ.get(n)) for n in after if n in DAY_OF]
    days = [r["day"] for r in reduce(DataFrame.unionByName, parts).distinct().collect() if r["day"] is not None]
    return sorted(_reached(days, anchors, reach) | (set(anchors.dates) - set(stored)))


def _drop_dates(spark: SparkSession, path: str, frame: str, dates: Sequence[dt.date]) -> None:
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in dates:
        files.delete(paths(f"{path.rstrip('/')}/{frame}/as_of={day.isoformat()}"), True)


def _params(lenses: Sequence[Lens], settings: Settings) -> dict[str, dict[str, float]]:
    return {lens.id: {k: float(v) for k, v in resolve_params(lens, settings.params.get(lens.id)).items()} for lens in lenses}


def update_history(
    spark: SparkSession,
    path: str,
    before: Tables,
    after: Tables,
    anchors: Anchors,
    settings: Settings | None = None,
) -> list[dt.date]:
    """Makes the history at `path`, which was built from `before`, that of `after`;
    returns the dates that were computed.

    Dates are taken out header first and put back header last. One without a header
    counts as not stored, so a run that was cut off is made good by the next.
    Lenses, parameters and window must be those of the stored history.
    """
    settings = settings or Settings()
    stored = H.open_history(spark, path)
    lenses = load_lenses(settings.enabled)
    head = stored.header.select("as_of", "period").orderBy("as_of").collect()  # a row per date
    params = _params(lenses, settings)
    widths = {(r["period"]["current_end"] - r["period"]["current_start"]).days + 1 for r in head}
    if [lens.id for lens in stored.lenses] != [lens.id for lens in lenses] or dict(stored.params) != params or widths != {anchors.window_days}:
        raise ValueError("lenses, parameters or window differ from the stored history: build it anew")
    reach = max([2 * anchors.window_days, *(int(v.get("velocity_window_days", 0)) for v in params.values())])
    dates = dates_to_compute(before, after, anchors, [r["as_of"] for r in head], reach)
    gone = sorted({r["as_of"] for r in head} - set(anchors.dates))
    names = list(stored.frames())
    for name in sorted(names, key=lambda n: n != "header"):
        _drop_dates(spark, path, name, [*dates, *gone])
    if dates:
        built = H.build_history(spark, after, Anchors(tuple(dates), anchors.window_days), lenses, settings, store_shared=True, by_date=True)
        H.append_history(built, path)
    return dates
