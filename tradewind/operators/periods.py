"""Comparison periods and additive totals per as-of date.

For an as-of date ``a`` and a window of ``w`` days the current period is
``[a-(w-1), a]`` and the previous one ``[a-(2w-1), a-w]``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIOD_COLUMNS = ("current_start", "current_end", "previous_start", "previous_end")


@dataclass(frozen=True)
class Anchors:
    """Ascending as-of dates that share one window length.

    Dates with a constant step (the normal case) are handled by arithmetic;
    any other list works too and is carried as a literal array.
    """

    dates: tuple[dt.date, ...]
    window_days: int = 30

    def __post_init__(self) -> None:
        if not self.dates:
            raise ValueError("at least one as-of date is needed")
        if self.window_days < 1:
            raise ValueError("window_days must be positive")
        object.__setattr__(self, "dates", tuple(sorted(set(self.dates))))

    @classmethod
    def single(cls, as_of: dt.date, window_days: int = 30) -> Anchors:
        return cls((as_of,), window_days)

    @classmethod
    def back_from(
        cls,
        latest: dt.date,
        earliest: dt.date,
        window_days: int = 30,
        spacing_days: int = 1,
        count: int | None = None,
    ) -> Anchors:
        """Every `spacing_days` back from `latest`, as long as both periods
        lie within the data that starts on `earliest`."""
        room = (latest - earliest).days - (2 * window_days - 1)
        possible = room // spacing_days + 1 if room >= 0 else 0
        if count is not None:
            possible = min(possible, count)
        return cls(tuple(latest - dt.timedelta(days=i * spacing_days) for i in range(possible)), window_days)

    def with_window(self, window_days: int) -> Anchors:
        return Anchors(self.dates, window_days)

    @property
    def latest(self) -> dt.date:
        return self.dates[-1]

    @property
    def step(self) -> int | None:
        """Constant distance in days; None where distances differ."""
        gaps = {(b - a).days for a, b in zip(self.dates, self.dates[1:])}
        if not gaps:
            return 1
        return gaps.pop() if len(gaps) == 1 else None

    def first_day(self, periods: int = 2) -> dt.date:
        return self.dates[0] - dt.timedelta(days=periods * self.window_days - 1)

    def covers(self, day: Column, periods: int = 2) -> Column:
        """Days that belong to at least one period; literal bounds, so the
        filter reaches the scan."""
        return day.between(F.lit(self.first_day(periods)), F.lit(self.latest))

    def holds(self, day: Column) -> Column:
        """Whether `day` is itself an as-of date."""
        if self.step is None:
            return day.isin(*[F.lit(d) for d in self.dates])
        inside = day.between(F.lit(self.dates[0]), F.lit(self.latest))
        return inside if self.step == 1 else inside & (F.datediff(day, F.lit(self.dates[0])) % self.step == 0)

    def index_from(self, day: Column) -> Column:
        """Position of the first as-of date on or after `day`."""
        if self.step is None:
            earlier = F.filter(F.array(*[F.lit(d) for d in self.dates]), lambda a: a < day)
            return F.size(earlier)
        behind = F.datediff(day, F.lit(self.dates[0])) / F.lit(self.step)
        return F.greatest(F.ceil(behind), F.lit(0)).cast("int")

    def date_at(self, index: Column) -> Column:
        if self.step is None:
            return F.element_at(F.array(*[F.lit(d) for d in self.dates]), index + 1)
        return F.date_add(F.lit(self.dates[0]), (index * F.lit(self.step)).cast("int"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per as-of date with its four period bounds."""
        return with_periods(
            spark.range(len(self.dates)).select(self.date_at(F.col("id").cast("int")).alias("as_of")),
            self.window_days,
        )


def with_periods(anchors: DataFrame, window_days: int) -> DataFrame:
    """Adds the bounds of both periods to a frame with an ``as_of`` column."""
    return anchors.withColumns(
        {
            "current_start": F.date_sub("as_of", window_days - 1),
            "current_end": F.col("as_of"),
            "previous_start": F.date_sub("as_of", 2 * window_days - 1),
            "previous_end": F.date_sub("as_of", window_days),
        }
    )


def period_of(day: Column, as_of: Column, window_days: int) -> Column:
    """``current``, ``previous`` or NULL."""
    age = F.datediff(as_of, day)
    return F.when(age.between(0, window_days - 1), F.lit("current")).when(
        age.between(window_days, 2 * window_days - 1), F.lit("previous")
    )


def data_bounds(orders: DataFrame, marketing: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: latest day over the three tables (empty ones do not count)
    and the earliest order day."""
    dated = (
        orders.agg(F.max("order_date").alias("latest"), F.min("order_date").alias("earliest"))
        .unionByName(marketing.agg(F.max("date").alias("latest")), allowMissingColumns=True)
        .unionByName(inventory.agg(F.max("date").alias("latest")), allowMissingColumns=True)
    )
    return dated.agg(F.max("latest").alias("latest"), F.min("earliest").alias("earliest"))


def history_anchors(
    bounds: DataFrame, window_days: int = 30, spacing_days: int = 1, count: int | None = None
) -> DataFrame:
    """As-of dates that `bounds` supports, as a lazy frame."""
    steps = F.floor((F.datediff("latest", "earliest") - (2 * window_days - 1)) / F.lit(spacing_days))
    last = steps if count is None else F.least(steps, F.lit(count - 1))
    return (
        bounds.filter(steps >= 0)
        .select("latest", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("back"))
        .select(F.date_sub("latest", (F.col("back") * spacing_days).cast("int")).alias("as_of"))
    )


def resolve_anchors(
    orders: DataFrame,
    marketing: DataFrame,
    inventory: DataFrame,
    window_days: int = 30,
    spacing_days: int = 1,
    count: int | None = None,
) -> Anchors:
    """`history_anchors` as literals, so period filters reach the scans.

    Reads the one-row bounds to the driver, nothing else.
    """
    row = data_bounds(orders, marketing, inventory).first()
    if row["latest"] is None or row["earliest"] is None:
        raise ValueError("no dated rows: cannot choose as-of dates")
    return Anchors.back_from(row["latest"], row["earliest"], window_days, spacing_days, count)


def nearest_anchor(picked: DataFrame, available: DataFrame) -> DataFrame:
    """For each ``picked`` day the same or closest earlier ``as_of``; where
    there is none, the first one.

    Both sides shrink to distinct calendar days and are merged into one ordered
    run, so there is no inequality join. The run holds one row per day of the
    calendar (365 a year) whatever the size of the inputs, which is what makes
    the unpartitioned window safe.
    """
    days = picked.select(F.col("picked").alias("day"), F.lit(True).alias("wanted"))
    dates = available.select(F.col("as_of").alias("day"), F.col("as_of"))
    calendar = (
        days.unionByName(dates, allowMissingColumns=True)
        .groupBy("day")
        .agg(F.max("as_of").alias("as_of"), F.max("wanted").alias("wanted"))
    )
    run = Window.orderBy("day")
    seen = F.max("as_of").over(run.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("as_of").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        calendar.withColumn("nearest", F.coalesce(seen, first))
        .filter("wanted")
        .select(F.col("day").alias("picked"), F.col("nearest").alias("as_of"))
    )


def period_totals(
    facts: DataFrame,
    anchors: Anchors,
    day: str,
    keys: Sequence[str],
    measures: Mapping[str, str],
    previous: bool = True,
) -> DataFrame:
    """``current_<m>`` and ``previous_<m>`` sums per as-of date and `keys`.

    `measures` are the SQL of exact numbers (counts, or money as DECIMAL): totals
    over many dates are built by adding and taking away days, which only exact
    numbers allow. A NULL measure counts as 0. Groups without a row in either period are left out; without `keys`
    every as-of date gets a row.

    One date: a single conditional aggregation. Many dates: rows are first
    summed per (day, keys), which bounds a group to one row per calendar day
    whatever its size in the raw data. Each daily sum then enters the current
    period, moves to the previous one and leaves it at three known dates, so
    totals are running sums over three change points, not one copy of the row
    per as-of date.
    """
    periods = 2 if previous else 1
    inside = facts.filter(anchors.covers(F.col(day), periods))
    if len(anchors.dates) == 1:
        return _single_totals(inside, anchors, day, keys, measures, previous)
    daily = inside.groupBy(*keys, day).agg(
        *(F.expr(f"coalesce(sum({sql}), 0L)").alias(m) for m, sql in measures.items()), F.expr("count(1)").alias("_rows")
    )
    if not keys:
        return _overall_totals(daily, anchors, day, list(measures), previous)
    return _running_totals(daily, anchors, day, list(keys), list(measures), previous)


def _sides(previous: bool) -> tuple[str, ...]:
    return ("current", "previous") if previous else ("current",)


def _single_totals(inside, anchors, day, keys, measures, previous):
    tagged = inside.withColumn("_period", period_of(F.col(day), F.lit(anchors.latest), anchors.window_days))
    return (
        tagged.groupBy(*keys)
        .agg(
            *(
                F.expr(f"coalesce(sum(if(_period = '{s}', {sql}, 0L)), 0L)").alias(f"{s}_{m}")
                for s in _sides(previous)
                for m, sql in measures.items()
            )
        )
        .select(
            F.lit(anchors.latest).alias("as_of"), *keys, *(f"{s}_{m}" for s in _sides(previous) for m in measures)
        )
    )


def _overall_totals(daily, anchors, day, names, previous):
    width = anchors.window_days
    entered = anchors.index_from(F.col(day))
    moved = anchors.index_from(F.date_add(day, width))
    gone = anchors.index_from(F.date_add(day, 2 * width)) if previous else moved
    last = F.least(gone, F.lit(len(anchors.dates))) - 1
    spread = (
        daily.withColumns({"_from": entered, "_moved": moved, "_last": last})
        .filter(F.col("_from") <= F.col("_last"))
        .withColumn("_at", F.explode(F.sequence("_from", "_last")))
    )
    inside = {"current": "_at < _moved", "previous": "_at >= _moved"}
    summed = spread.groupBy("_at").agg(
        *(F.expr(f"sum(if({inside[s]}, {m}, 0L))").alias(f"{s}_{m}") for s in _sides(previous) for m in names)
    )
    every = daily.sparkSession.range(len(anchors.dates)).select(F.col("id").cast("int").alias("_at"))
    return every.join(summed, "_at", "left").select(
        anchors.date_at(F.col("_at")).alias("as_of"),
        *(F.expr(f"coalesce({s}_{m}, 0L)").alias(f"{s}_{m}") for s in _sides(previous) for m in names),
    )


def _running_totals(daily, anchors, day, keys, names, previous):
    width = anchors.window_days
    change = lambda shift, cur, prev: F.struct(
        anchors.index_from(F.date_add(day, shift)).alias("at"), F.lit(cur).alias("cur"), F.lit(prev).alias("prev")
    )
    if previous:
        changes = F.array(change(0, 1, 0), change(width, -1, 1), change(2 * width, 0, -1))
    else:
        changes = F.array(change(0, 1, 0), change(width, -1, 0))
    measured = [*names, "_rows"]
    factor = {"current": "_change.cur", "previous": "_change.prev"}
    columns = [f"{s}_{m}" for s in _sides(previous) for m in measured]
    # Placing each group's days together before the change points are made
    # serves both the grouping and the running sum below: one exchange.
    steps = (
        daily.repartition(*keys)
        .withColumn("_change", F.explode(changes))
        .filter(F.col("_change.at") < len(anchors.dates))
        .groupBy(*keys, F.col("_change.at").alias("_at"))
        .agg(*(F.expr(f"sum({m} * {factor[s]})").alias(f"{s}_{m}") for s in _sides(previous) for m in measured))
    )
    order = Window.partitionBy(*keys).orderBy("_at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = steps.select(
        *keys,
        "_at",
        (F.lead("_at", 1, len(anchors.dates)).over(order) - 1).alias("_until"),
        *(F.sum(c).over(running).alias(c) for c in columns),
    )
    present = F.col("current__rows") + F.col("previous__rows") if previous else F.col("current__rows")
    return (
        totals.filter(present > 0)
        .withColumn("_at", F.explode(F.sequence("_at", "_until")))
        .select(
            anchors.date_at(F.col("_at")).alias("as_of"),
            *keys,
            *(f"{s}_{m}" for s in _sides(previous) for m in names),
        )
    )


def distinct_totals(
    facts: DataFrame, anchors: Anchors, day: str, entity: str, keys: Sequence[str] = (), name: str = "entities"
) -> DataFrame:
    """``current_<name>`` and ``previous_<name>``: different values of `entity` with a
    row in each period, per as-of date and `keys`.

    An entity counts on the dates from a day it occurs on until its next day, or
    until that day leaves the period: pieces that don't overlap. Each adds one
    where it begins and takes one away where it ends, so an entity on many days counts
    once in every window. Without `keys` every as-of date gets a row.
    """
    width, n = anchors.window_days, len(anchors.dates)
    own = Window.partitionBy(entity, *keys).orderBy(day)
    days = facts.filter(anchors.covers(F.col(day))).select(entity, *keys, day).distinct()
    left = F.date_add(day, width)
    until = F.least(left, F.coalesce(F.lead(day).over(own), left))
    pieces = days.select(*keys, F.col(day).alias("_from"), until.alias("_to"))

    def change(at: str, shift: int, side: str, step: int) -> Column:
        one, none = F.lit(step).cast("bigint"), F.lit(0).cast("bigint")
        return F.struct(
            anchors.index_from(F.date_add(at, shift)).alias("_at"),
            (one if side == "current" else none).alias("current"),
            (one if side == "previous" else none).alias("previous"),
        )

    changes = F.array(
        change("_from", 0, "current", 1), change("_to", 0, "current", -1),
        change("_from", width, "previous", 1), change("_to", width, "previous", -1),
    )
    steps = (
        pieces.select(*keys, F.inline(changes))
        .filter(F.col("_at") < n)
        .groupBy(*keys, "_at")
        .agg(F.sum("current").alias("current"), F.sum("previous").alias("previous"))
    )
    if not keys:  # a row per as-of date, also where nothing changes
        none = F.lit(0).cast("bigint")
        every = facts.sparkSession.range(n).select(F.col("id").cast("int").alias("_at"), none.alias("current"), none.alias("previous"))
        steps = steps.unionByName(every).groupBy("_at").agg(F.sum("current").alias("current"), F.sum("previous").alias("previous"))
    # One row per as-of date at most, by key.
    order = Window.partitionBy(*keys).orderBy("_at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    sides = ("current", "previous")
    totals = steps.select(
        *keys, "_at", (F.lead("_at", 1, n).over(order) - 1).alias("_until"), *(F.sum(s).over(run).alias(s) for s in sides)
    )
    if keys:
        totals = totals.filter(F.col("current") + F.col("previous") > 0)
    return totals.withColumn("_at", F.explode(F.sequence("_at", "_until"))).select(
        anchors.date_at(F.col("_at")).alias("as_of"), *keys, *(F.col(s).alias(f"{s}_{name}") for s in sides)
    )
