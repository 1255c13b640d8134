"""Moments, days and periods. Days are UTC calendar days whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a moment as text with a zone (Z or an offset); whether its parts are possible is left to the cast.
#: Written without braces, which DataFrame parameters of spark.sql() would take for their own.
ZONED_MOMENT = r"^\s*\d\d\d\d-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d([.,]\d+)?)?\s?([Zz]|[+-]\d\d(:?\d\d)?)\s*\z"
OFFSET_END = r"\s?([+-]\d\d):?(\d\d)?\s*\z"
MICROS_PER_DAY = 86_400_000_000


def zoned_moment_sql(text: str) -> str:
    """SQL for the moment that a text names; NULL for null, empty, unreadable, impossible and zoneless texts."""
    tidy = f"regexp_replace(replace(trim({text}), ',', '.'), r'{OFFSET_END}', '$1:$2')"
    tidy = f"regexp_replace(regexp_replace(upper({tidy}), ':$', ':00'), ' Z$', 'Z')"
    tidy = f"regexp_replace({tidy}, r'([T ]\\d\\d:\\d\\d)(?=[Z+-])', '$1:00')"
    return f"CASE WHEN {text} RLIKE r'{ZONED_MOMENT}' THEN try_cast({tidy} AS timestamp) END"


def zoned_moment(text: str) -> Column:
    """zoned_moment_sql() of a column as a Column."""
    return F.expr(zoned_moment_sql(text))


def utc_day_sql(moment: str) -> str:
    """SQL for the UTC calendar day of a timestamp."""
    return f"date_from_unix_date(cast(floor(unix_micros({moment}) / {MICROS_PER_DAY}D) AS int))"


def utc_day(moment: str) -> Column:
    """The UTC calendar day of a timestamp."""
    return F.expr(utc_day_sql(moment))


#: Notations of a compact date, tried in order.
COMPACT_DATES = (("^[0-9]{8}$", "yyyyMMdd"), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"))


def compact_date(text: Column) -> Column:
    """The day of a compact date in one of three notations; null for anything else, also for days that don't exist."""
    tidy = F.trim(text)
    return F.coalesce(*[F.when(tidy.rlike(shape), F.try_to_timestamp(tidy, F.lit(pattern)).cast("date")) for shape, pattern in COMPACT_DATES])
