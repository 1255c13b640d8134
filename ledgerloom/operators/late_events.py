"""Period totals corrected as late records arrive: an event-period by arrival-period triangle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.temporal import utc_day_sql, zoned_moment_sql

CUTOFF_MS = 72 * 3_600_000
#: Input rows in a row of whose cells refused records are kept together: a cell with more has several pieces.
PIECE_ROWS = 32_768


def _placed(group: str, keys: list[str], occurred_at: str, recorded_at: str, cutoff_ms: int, piece_rows: int) -> str:
    """Each readable record with its cell of the triangle, its piece of that cell, and whether it came after the cut-off."""
    row = f", struct({', '.join(dict.fromkeys(keys))}) AS row, monotonically_increasing_id() DIV {int(piece_rows)} AS piece" if keys else ", 0L AS piece"
    return f"""
SELECT *, {utc_day_sql("occurred")} AS event_day, {utc_day_sql("recorded")} AS arrival_day,
       unix_millis(recorded) - unix_millis(occurred) > {int(cutoff_ms)} AS beyond
FROM (SELECT {group} AS series, {zoned_moment_sql(occurred_at)} AS occurred, {zoned_moment_sql(recorded_at)} AS recorded{row} FROM {{records}})
WHERE occurred IS NOT NULL AND recorded IS NOT NULL"""


def triangle_sql(group: str, keys: list[str], occurred_at: str, recorded_at: str, cutoff_ms: int, piece_rows: int = PIECE_ROWS) -> str:
    """SQL for the triangle over ``{records}``: one row a cell, its counts added on the map side.

    Columns: series, event_day, arrival_day, piece, ``arrived`` in time and ``refused`` as beyond the cut-off. With ``keys``,
    the cell also keeps the ``keys`` of its refused records in ``beyond_rows``, in pieces of at most ``piece_rows``
    neighbouring input rows, so that no cell, however hot, is gathered as a whole.
    """
    kept = ", collect_list(row) FILTER (WHERE beyond) AS beyond_rows" if keys else ""
    return f"""
SELECT series, event_day, arrival_day, piece, count_if(NOT beyond) AS arrived, count_if(beyond) AS refused{kept}
FROM ({_placed(group, keys, occurred_at, recorded_at, cutoff_ms, piece_rows)}) GROUP BY series, event_day, arrival_day, piece"""


def revisions(records: DataFrame, group: str = "event_type", occurred_at: str = "occurred_at", recorded_at: str = "recorded_at", cutoff_ms: int = CUTOFF_MS) -> DataFrame:
    """Every corrected count per ``group`` and UTC day of ``occurred_at``.

    One row per group, event day and arrival day that brought records: ``arrived`` on that day, ``corrected_total`` so
    far, ``revision`` from 1, and ``is_latest`` for the one that stands. Records more than ``cutoff_ms`` late are left out
    (exactly the cut-off still counts); early ones count. A null group is a group of its own. Texts that are null, empty,
    unreadable or without a zone give no record; repeated records count as often as they stand; an empty table gives no
    rows. Other columns, also of clashing names, aren't read.
    """
    return records.sparkSession.sql(
        f"""
SELECT series AS {group}, event_day, arrival_day, arrived,
       sum(arrived) OVER (PARTITION BY series, event_day ORDER BY arrival_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS corrected_total,
       cast(row_number() OVER (PARTITION BY series, event_day ORDER BY arrival_day) AS bigint) AS revision,
       arrival_day = max(arrival_day) OVER (PARTITION BY series, event_day) AS is_latest
FROM ({triangle_sql(group, [], occurred_at, recorded_at, cutoff_ms)}) WHERE arrived > 0""",
        records=records,
    )


def beyond_cutoff(records: DataFrame, keys: list[str], group: str = "event_type", occurred_at: str = "occurred_at", recorded_at: str = "recorded_at", cutoff_ms: int = CUTOFF_MS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``keys`` of the records that the triangle refuses: more than ``cutoff_ms`` late, to the millisecond, each by itself.

    The triangle over all readable records is built in one scan; what its cells keep of arrivals beyond the cut-off comes
    out. Nulls, ties and repeats are treated as in revisions().
    """
    names = ", ".join(f"refusal.{k} AS {k}" for k in keys)
    return records.sparkSession.sql(
        f"SELECT {names} FROM (SELECT explode(beyond_rows) AS refusal FROM ({triangle_sql(group, keys, occurred_at, recorded_at, cutoff_ms, piece_rows)}) WHERE refused > 0)",
        records=records,
    )
