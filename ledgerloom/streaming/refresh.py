"""Days recomputed for as long as late rows may still change them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import replace_days


def refresh(rows: DataFrame, moment: str, day: Callable[[str], Column], days: int, fold: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Folds the last ``days`` days anew and puts them in place of the same days of the table in ``folder``.

    ``fold`` gives ``business_date``. Rows are picked by their moment first, two days more than asked for, so that the scan
    can skip; then by their day. Rows that came late, were changed or deleted are thereby right; older days stay.
    """
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")
    last = rows.agg(F.max(moment).alias("m"), F.max(day(moment)).alias("d")).first()
    if last["d"] is None:
        return
    near = rows.filter((F.col(moment) >= F.lit(last["m"]) - F.expr(f"INTERVAL {days + 2} DAYS")) & (day(moment) > F.date_sub(F.lit(last["d"]), days)))
    replace_days(fold(near), folder, "business_date")
