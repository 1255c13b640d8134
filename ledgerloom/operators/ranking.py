"""Places in one order over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_IN_PARTITION = 2**33


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with ``rank`` from 1 by ``order`` (make it total for repeatable ties) and ``rank_count``, the number of rows.

    A range-partitioned sort is written to the shared folder; a row's rank is its place in its partition after the rows of
    the partitions before, whose sums (one row a partition) are broadcast.
    """
    placed = cut(rows.orderBy(*order)).withColumn("id", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.floor(F.col("id") / _IN_PARTITION), "within": F.col("id") % _IN_PARTITION}).drop("id")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.orderBy("part")
    before = counts.select("part", (F.sum("n").over(everything) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("rank_count"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("within") + 1).drop("part", "within", "before")


def tile(rank: Column, count: Column, tiles: int) -> Column:
    """The one of ``tiles`` groups of equal size that a rank falls in; the first ones are larger by one where it must be."""
    large, size = count % tiles, F.floor(count / tiles)
    border = large * (size + 1)
    late = F.floor((rank - border - 1) / F.greatest(size, F.lit(1))) + large + 1
    return F.when(rank <= border, F.floor((rank - 1) / (size + 1)) + 1).otherwise(late).cast("int")
