"""Totals over trailing days, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import utc_day_sql


def trailing_totals(records: DataFrame, entity: str, moment: str, amount: str, periods: tuple[int, ...] = (7, 30), record_id: str | None = None) -> DataFrame:
    """Per ``entity`` and each UTC day from its first to its last: the day's total, and totals and daily averages over the last n days.

    Columns: entity, ``day``, ``day_total``, and per n of ``periods``: ``total_nd`` and ``average_nd`` (the total by n, also
    where fewer than n days lie behind: days before the first are days without activity). Daily sums are made on the map
    side; each entity is joined with its calendar laterally, from each active day to the eve of the next, so that no pair
    outside its span is made and nothing is joined back; the frames count rows, as every day has one.
    Rows with a null entity, moment or amount don't count. With ``record_id``, records delivered again (same id, entity,
    day and amount) count once; records whose id is null are told apart from each other. An empty table gives no rows.
    """
    spark = records.sparkSession
    day = utc_day_sql("moment")
    source = records.select(*[F.col(c).alias(a) for c, a in ((entity, "entity"), (moment, "moment"), (amount, "amount"))], (F.col(record_id) if record_id else F.lit(None).cast("string")).alias("record_id"))
    if record_id:
        # one row a record: a plain hash aggregate without buffers but a count, for records without an id
        counted = f"""SELECT entity, day, amount * if(record_id IS NULL, copies, 1L) AS amount FROM (
            SELECT record_id, entity, {day} AS day, cast(amount AS bigint) AS amount, count(*) AS copies
            FROM {{source}} WHERE entity IS NOT NULL AND moment IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2, 3, 4)"""
    else:
        counted = f"SELECT entity, {day} AS day, cast(amount AS bigint) AS amount FROM {{source}} WHERE entity IS NOT NULL AND moment IS NOT NULL AND amount IS NOT NULL"
    frames = ", ".join(f"sum(day_total) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS total_{n}d" for n in periods)
    averages = ", ".join(f"round(total_{n}d / {n}D, 6) AS average_{n}d" for n in periods)
    totals = ", ".join(f"total_{n}d" for n in periods)
    return spark.sql(
        f"""
WITH daily AS (SELECT entity, day, sum(amount) AS day_total FROM ({counted}) GROUP BY entity, day),
     spans AS (SELECT entity, day AS active, day_total, coalesce(date_sub(lead(day) OVER (PARTITION BY entity ORDER BY day), 1), day) AS until FROM daily),
     dense AS (SELECT entity, day, if(day = active, day_total, 0L) AS day_total FROM spans CROSS JOIN LATERAL explode(sequence(active, until)) AS calendar(day)),
     summed AS (SELECT entity, day, day_total, {frames} FROM dense)
SELECT entity AS {entity}, day, day_total, {totals}, {averages} FROM summed""",
        source=source,
    )


def idle_days(totals: DataFrame, entity: str, period: int) -> DataFrame:
    """The days on which the trailing total over ``period`` days is zero."""
    none: Column = F.col(f"total_{period}d") == 0
    return totals.filter(none).select(entity, "day")
