"""Running totals and previous values along an order within keys, also where one key has most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def along(rows: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running totals (this row included) and values of the row before, per key by ``order``.

    One sort by keys and order, range-partitioned, so that a key with most rows lies in many partitions; it is written to the
    shared folder. Windows then reach over a key's rows of one partition only; what the partitions before add (one row a
    partition and key) is joined in. ``order`` should be total, or ties fall as they may. Null totals count 0; null keys are
    a key. The columns line_part and line_id are used inside.
    """
    totals, previous = totals or {}, previous or {}
    source = rows.withColumns({f"line_{n}": F.coalesce(v, F.lit(0)) for n, v in totals.items()} | {f"line_{n}": v for n, v in previous.items()})
    line = cut(source.orderBy(*keys, *order)).withColumn("line_id", F.monotonically_increasing_id())
    line = line.withColumn("line_part", F.shiftright("line_id", 33))
    own = Window.partitionBy("line_part", *keys).orderBy("line_id")
    last = lambda n: F.max_by(F.struct(f"line_{n}"), "line_id")  # noqa: E731  a struct, so that a null is a value
    parts = line.groupBy("line_part", *keys).agg(F.count(F.lit(1)).alias("line_rows"), *[F.sum(f"line_{n}").alias(f"sum_{n}") for n in totals], *[last(n).alias(f"last_{n}") for n in previous])
    before = Window.partitionBy(*keys).orderBy("line_part")
    carried = parts.select(F.col("line_part").alias("carry_part"), *[F.col(k).alias(f"carry_{k}") for k in keys], *[(F.sum(f"sum_{n}").over(before) - F.col(f"sum_{n}")).alias(f"sum_{n}") for n in totals], *[F.lag(f"last_{n}").over(before).alias(f"last_{n}") for n in previous])
    same = F.col("line_part") == F.col("carry_part")
    for k in keys:
        same = same & line[k].eqNullSafe(F.col(f"carry_{k}"))
    joined = line.join(carried, same, "left")
    first = F.row_number().over(own) == 1
    added = {n: F.sum(f"line_{n}").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"sum_{n}") for n in totals}
    added |= {n: F.when(first, F.col(f"last_{n}")[f"line_{n}"]).otherwise(F.lag(f"line_{n}").over(own)) for n in previous}
    return joined.select(*rows.columns, *[value.alias(n) for n, value in added.items()])
