"""Alerts held back for a while after the last one, unless they are graver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import along


def _next_alert(moments: np.ndarray, ranks: np.ndarray, graver: dict[int, np.ndarray], first: int, since: int, end: int, due: int, rank: int) -> int:
    """The first place from ``since`` to ``end`` with a moment not before ``due`` or a greater rank; ``end`` for none."""
    if rank not in graver:
        graver[rank] = first + np.flatnonzero(ranks[first:end] > rank)
    k = np.searchsorted(graver[rank], since)
    late = since + int(np.searchsorted(moments[since:end], due))
    return min(late, int(graver[rank][k])) if k < len(graver[rank]) else late


def alerts(events: DataFrame, key: str, moment: str, rank: str, event_id: str, seconds: int) -> DataFrame:
    """Events that alert: the first of a key, those of a greater rank than the last alert, and those ``seconds`` after it.

    After a pause of ``seconds`` an event alerts whatever came before, so a key's history falls into stretches that don't
    depend on each other. They are spread over tasks by key and stretch, sorted there, and folded in arrays: from an alert
    the next one is looked up, the first event late enough or the first of a greater rank, so work grows with alerts, not
    with events. A stretch without a pause is one task's, batch by batch, with the last alert as the only state. Ties go by
    id. Rows with a null key, moment or rank never alert.
    """
    known = events.select(F.col(key).alias("key"), F.col(moment).alias("moment"), F.col(rank).cast("int").alias("rank"), F.col(event_id).alias("event_id")).dropna()
    before = along(known, ["key"], ["moment", "event_id"], previous={"before": F.col("moment")})
    paused = F.coalesce(F.unix_micros("moment") - F.unix_micros("before") >= seconds * 1_000_000, F.lit(True))
    stretches = along(before.withColumn("pause", F.when(paused, 1).otherwise(0)), ["key"], ["moment", "event_id"], {"stretch": F.col("pause")})
    sorted_rows = stretches.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "moment", "event_id").withColumn("micros", F.unix_micros("moment"))

    pause = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last_at, last_rank = None, 0, 0
        for batch in batches:
            moments, ranks = batch.column("micros").to_numpy(), batch.column("rank").to_numpy()
            codes = np.stack([pc.dictionary_encode(batch.column(c)).indices.to_numpy() for c in ("key", "stretch")])
            starts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            taken: list[int] = []
            for first, end in zip(starts, starts[1:]):
                if first == end:
                    continue
                own, graver, i = tuple(batch.column(c)[first].as_py() for c in ("key", "stretch")), {}, first
                if own == now:  # goes on from the batch before
                    i = _next_alert(moments, ranks, graver, first, first, end, last_at + pause, last_rank)
                while i < end:
                    taken.append(i)
                    last_at, last_rank = int(moments[i]), int(ranks[i])
                    i = _next_alert(moments, ranks, graver, first, i + 1, end, last_at + pause, last_rank)
                now = own
            yield batch.take(pa.array(taken, type=pa.int64())).select(["key", "moment", "rank", "event_id"])

    schema = sorted_rows.select("key", "moment", "rank", "event_id").schema
    return sorted_rows.mapInArrow(fold, schema).select(F.col("key").alias(key), F.col("moment").alias(moment), F.col("rank").alias(rank), F.col("event_id").alias(event_id))
