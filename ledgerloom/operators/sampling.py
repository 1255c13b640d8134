"""Samples that come out the same each time: by hash, by bucket, by budget of rows with whole histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(key: Column, buckets: int) -> Column:
    """A number from 0 to buckets - 1 from the first 60 bits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(buckets))


def top_of_each(rows: DataFrame, bucket: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each bucket; Spark keeps that many per task before rows move."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return ranked.filter(F.col("place") <= most).drop("place")


def within_budget(rows: DataFrame, key: list[str], budget: int, name: Column) -> DataFrame:
    """Whole histories, in order of their keys' hashes, as long as all rows so far fit the budget; the first always.

    The order is global, yet nothing is sorted in one place: keys are added up by the leading 12 bits of their hash (at
    most 4,096 sums), running totals of those place each key, and only keys of one such range are sorted together.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("history")).withColumn("hash", F.md5(name)).withColumn("range", F.substring("hash", 1, 3))
    # at most 4,096 rows
    ranges = sizes.groupBy("range").agg(F.sum("history").alias("in_range"))
    before = ranges.select("range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("before"))
    running = F.sum("history").over(Window.partitionBy("range").orderBy("hash", *key))
    placed = sizes.join(F.broadcast(before), "range").withColumn("so_far", F.col("before") + running)
    taken = placed.filter((F.col("so_far") <= budget) | ((F.col("before") == 0) & (F.col("so_far") == F.col("history")))).select(*key)
    return rows.join(taken, key, "left_semi")
