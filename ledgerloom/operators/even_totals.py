"""Per-key totals that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spread import spread_join


def key_totals(rows: DataFrame, key: str, amounts: list[str]) -> DataFrame:
    """Rows and sums of ``amounts`` per non-null ``key``, as delivered: columns ``key_value``, ``row_count`` and one sum an amount.

    All states (counts, decimal and integer sums) merge, so each task folds its rows into a hash table bounded by its
    memory (Spark sorts and spills it beyond), and one small row a key and task is shuffled, however hot the key. Floating
    amounts are summed too, but only to rounding. Nulls in an amount are skipped; a key without any gives a null sum.
    Rows with a null key are left out; an empty table gives no rows.
    """
    picked = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key_value"), *[F.col(a).alias(f"amount_{i}") for i, a in enumerate(amounts)])
    return picked.groupBy("key_value").agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(f"amount_{i}").alias(a) for i, a in enumerate(amounts)])


def totals_once(rows: DataFrame, key: str, amounts: list[str], row_id: str) -> DataFrame:
    """key_totals() with rows delivered again counted once: same ``row_id``, key and amounts.

    All rows are totalled as delivered; then what the copies beyond the first add is taken off again. Ids are counted
    first, and only the rows of repeated ones are looked up and folded. Rows without an id are told apart from each other.
    """
    totals = key_totals(rows, key, amounts)
    named = [f"amount_{i}" for i in range(len(amounts))]
    picked = rows.filter(F.col(key).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(key).cast("string").alias("key_value"), *[F.col(a).alias(n) for a, n in zip(amounts, named)])
    repeated = cut(picked.groupBy("row_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    again = spread_join(picked, repeated, ["row_id"], "copies", "left_semi", rare=True, written=True)
    beyond = again.groupBy("row_id", "key_value", *named).agg((F.count(F.lit(1)) - 1).alias("copies")).filter("copies > 0")
    excess = beyond.groupBy("key_value").agg(F.sum("copies").alias("copies"), *[F.sum((F.col(n) * F.col("copies")).cast(totals.schema[a].dataType)).alias(n) for n, a in zip(named, amounts)])
    less = [(F.col(a) - F.coalesce(F.col(n), F.lit(0))).cast(totals.schema[a].dataType).alias(a) for n, a in zip(named, amounts)]
    # one row a key on either side
    return totals.join(excess, "key_value", "left").select("key_value", (F.col("row_count") - F.coalesce("copies", F.lit(0))).alias("row_count"), *less)


def heavy_keys(rows: DataFrame, key: str, one_in: int) -> DataFrame:
    """Non-null keys that hold at least one in ``one_in`` of all rows, rows with a null key included in the whole."""
    totals = key_totals(rows, key, [])
    whole = rows.agg(F.count(F.lit(1)).alias("whole"))
    # the whole is one row: a scalar, not a join of two tables
    return totals.sparkSession.sql(f"SELECT key_value, row_count FROM {{totals}} WHERE row_count * {int(one_in)} >= (SELECT whole FROM {{whole}})", totals=totals, whole=whole)
