"""Change batches by offsets: bounded, written once, verified, and only then counted as done."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources import offsets as at
from ..sources.sinks import append_once


def run_cycle(spark: SparkSession, records: DataFrame, manifest: str | Path, low: at.Offsets, high: at.Offsets, folder: str, event_id: str, most: int = 50_000) -> dict:
    """Takes the next batch of ``records`` from the manifest's offsets on into ``folder``; returns what it did.

    ``low`` and ``high`` are what the topics hold. Records that are gone before they were taken stop the cycle with the
    offsets as they were. The batch is named after its range; the manifest moves only when all its records are there with
    distinct ids, so a run that breaks off is made again and adds nothing twice. Delivery is at least once up to here, and
    once by name from here on.
    """
    start = at.with_new_partitions(at.read_manifest(manifest), low)
    if missing := at.gaps(start, low):
        raise RuntimeError(f"records are gone: {missing}")
    end = at.fair_end(start, high, most)
    expected = at.records_between(start, end)
    if not expected:
        return {"batch": None, "records": 0, "offsets": start}
    name = at.batch_name(start, end)
    written = append_once(spark, at.bounded(records, start, end), folder, name, event_id)
    if written != expected:
        raise RuntimeError(f"batch {name}: {written} of {expected} records")
    at.write_json(manifest, end)
    return {"batch": name, "records": written, "offsets": end}


def cut_over(positions: Callable[[], at.Offsets], snapshot: Callable[[], DataFrame], changes: Callable[[at.Offsets, at.Offsets], DataFrame], reconcile: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, at.Offsets]:
    """A snapshot with the changes made while it was taken, and the offsets to go on from.

    Offsets are read before and after the snapshot; what lies between is caught up with, so a change is in the snapshot, in
    the catch-up, or in both, where the last change of a key decides.
    """
    before = positions()
    taken = snapshot()
    after = positions()
    at.records_between(before, after)
    return reconcile(taken, changes(before, after)), after
