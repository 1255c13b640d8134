"""Daily series: dense grids, lags, windows back and ahead, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def dense(daily: DataFrame, entity: list[str], day: str, zeros: list[str]) -> DataFrame:
    """One row for each entity and each day of the whole table's calendar; ``zeros`` are 0 on days that weren't there.

    Entities are few beside their rows and the calendar is one row, an array, so the grid costs entities times days.
    """
    bounds = daily.agg(F.sequence(F.min(day), F.max(day)).alias("calendar"))
    entities = daily.select(*entity).distinct()
    grid = entities.join(F.broadcast(bounds)).select(*entity, F.explode("calendar").alias(day))
    return grid.join(daily, [*entity, day], "left").fillna(0, zeros)


def by_day(entity: list[str], day: str) -> WindowSpec:
    """Frames that count days, whether rows are there or not."""
    return Window.partitionBy(*entity).orderBy(F.unix_date(day).cast("long"))


def back(entity: list[str], day: str, days: int) -> WindowSpec:
    """The ``days`` days before this one."""
    return by_day(entity, day).rangeBetween(-days, -1)


def ahead(entity: list[str], day: str, days: int) -> WindowSpec:
    """The ``days`` days after this one; at the end fewer."""
    return by_day(entity, day).rangeBetween(1, days)


def strict(value: Column, window: WindowSpec, days: int) -> Column:
    """The value only where the window holds all of its days."""
    return F.when(F.count(F.lit(1)).over(window) == days, value)


def forward_filled(value: str, entity: list[str], day: str) -> Column:
    """The last value so far that isn't null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*entity).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
