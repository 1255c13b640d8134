"""Joins with a table of one row a key, even where a key meets most rows of the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of one key that a task may take.
ROWS_A_TASK = 1_000_000


#: Words of 64 bits in a sieve: from 2 KB to 2 MB. Two bits a key; up to about a million keys one in 70 others passes.
SIEVE_WORDS = (2**8, 2**18)


def spread_join(many: DataFrame, one: DataFrame, on: list[str], weight: str, how: str = "inner", rows_a_task: int = ROWS_A_TASK, rare: bool = False, written: bool = False) -> DataFrame:
    """``many`` joined with ``one`` on equal keys (null equals null); ``how`` is inner, left or left_semi.

    ``one`` has each key once, with the number of rows of ``many`` that it meets in ``weight``. It is written to the shared
    folder first (unless it is ``written``), so its own making isn't part of the join and Spark knows its size. Keys that meet more than
    ``rows_a_task`` are split: their rows get a part by hash, and the key a copy for each part. The keys that are split are
    broadcast to give the parts; there are at most as many as rows of ``many`` over ``rows_a_task``.
    With ``rare``, few rows of ``many`` have a partner: a bit sieve of the keys (bounded, see SIEVE_WORDS) tells most
    others before any shuffle; what passes it by chance just has no partner in the join, so the result is the same.
    ``many`` must have no columns named as those of ``one``, except the keys.
    """
    one = one if written else cut(one)
    found = one.agg(F.max(weight), F.count(F.lit(1))).first()
    kept = [c for c in one.columns if c not in on and c != weight]
    near, far = _parted(many, one, on, found[1]) if rare else (many, None)
    joined = _joined(near, one, on, weight, how, rows_a_task, found[0] or 0, kept)
    if far is None or how != "left":
        return joined
    types = dict(one.dtypes)
    return joined.unionByName(far.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in kept]))


def parted(many: DataFrame, one: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``many`` that may have a partner in ``one``, which is written, and those that surely have none.

    Of rows without a partner about one in 70 is among the former. Both read ``many``; nothing is shuffled.
    """
    return _parted(many, one, on, one.count())


def _parted(many: DataFrame, one: DataFrame, on: list[str], keys: int) -> tuple[DataFrame, DataFrame]:
    test, sieve = _sieve(one, on, keys)
    split = lambda condition: many.sparkSession.sql(f"SELECT * FROM {{many}} WHERE {condition}", many=many, sieve=sieve)
    return split(test), split(f"NOT ({test})")


def _sieve(one: DataFrame, on: list[str], keys: int) -> tuple[str, DataFrame]:
    """The condition that a row's key may be among those of ``one``, and the one row of bits that it reads."""
    words = SIEVE_WORDS[0]
    while words < min(SIEVE_WORDS[1], keys // 4):
        words *= 2
    key = f"xxhash64({', '.join(on)})"
    bits = [f"pmod({key}, {words * 64}L)", f"pmod(shiftrightunsigned({key}, 24), {words * 64}L)"]
    spark = one.sparkSession
    # every word is there, so that they make an array in order: at most SIEVE_WORDS[1] of them
    sieve = spark.sql(
        f"""
SELECT transform(array_sort(collect_list(struct(word, bits))), w -> w.bits) AS sieve FROM (
  SELECT word, bit_or(bits) AS bits FROM (
    SELECT shiftright(b, 6) AS word, shiftleft(1L, cast(b & 63 AS int)) AS bits FROM (SELECT explode(array({", ".join(bits)})) AS b FROM {{one}})
    UNION ALL SELECT id, 0L FROM range({words}))
  GROUP BY word)""",
        one=one,
    )
    return " AND ".join(f"getbit((SELECT sieve FROM {{sieve}})[cast(shiftright({b}, 6) AS int)], cast({b} & 63 AS int)) = 1" for b in bits), sieve


def _joined(many: DataFrame, one: DataFrame, on: list[str], weight: str, how: str, rows_a_task: int, heaviest: int, kept: list[str]) -> DataFrame:
    key = lambda left, right: reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"one_{k}"]) for k in on])
    renamed = one.select(*[F.col(k).alias(f"one_{k}") for k in on], *kept, F.ceil(F.col(weight) / F.lit(rows_a_task)).cast("int").alias("one_parts"))
    back = [] if how == "left_semi" else kept
    if heaviest <= rows_a_task:
        return many.join(renamed, key(many, renamed), how).select(*many.columns, *back)
    hot = renamed.filter("one_parts > 1").select(*[f"one_{k}" for k in on], F.col("one_parts").alias("parts"))
    parted = many.join(F.broadcast(hot), key(many, hot), "left").select(*many.columns, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("parts")), F.lit(0)).cast("int").alias("one_part"))
    copied = renamed.withColumn("copy_part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("one_parts"), F.lit(1)) - 1)))
    return parted.join(copied, key(parted, copied) & (parted["one_part"] == copied["copy_part"]), how).select(*many.columns, *back)
