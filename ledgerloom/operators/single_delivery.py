"""One copy of each message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import uuid_bytes
from ..session import cut
from .spread import ROWS_A_TASK, parted, spread_join


def _ranked(order: list[str]) -> Column:
    """A struct that sorts as the named columns do, nulls last."""
    return F.struct(*[part for c in order for part in (F.col(f"row.{c}").isNull().alias(f"{c}_missing"), F.col(f"row.{c}").alias(c))])


def _keyed(stored: DataFrame, new: DataFrame | None, identifier: str, identity) -> DataFrame:
    """All messages, stored and new, with their identity."""
    messages = stored if new is None else stored.unionByName(new)
    return messages.select(F.struct("*").alias("row")).withColumn("uid", identity(F.col(f"row.{identifier}")))


def _repeated(keyed: DataFrame) -> DataFrame:
    """The identities that occur more than once, with their number of messages, written.

    Counts combine on the map side, so an identifier with a third of all rows sends one row a task; nothing is ranked here.
    """
    known = keyed.filter(F.col("uid").isNotNull())
    return cut(known.groupBy("uid").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))


def repeated_deliveries(stored: DataFrame, keys: list[str], new: DataFrame | None = None, identifier: str = "event_id", order: list[str] | None = None, identity=uuid_bytes, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``keys`` of every copy but the first of its message, among the stored and the new ones together.

    Identifiers are split by frequency: those that occur once are done; only the records of repeated ones are looked up and
    ranked, and the first by ``order`` (nulls last) is the one to keep. ``order`` must tell records apart; records alike in
    all of it are one delivery and are kept or dropped together. Records whose identifier is null, empty or no UUID are
    messages of their own. The records of a hot identifier are spread over tasks of ``rows_a_task``.
    """
    keyed = _keyed(stored, new, identifier, identity).withColumn("place", _ranked(order or keys)).select("uid", "place").filter(F.col("uid").isNotNull())
    # written: read for the firsts and again beside them
    copies = cut(spread_join(keyed, _repeated(keyed), ["uid"], "copies", "left_semi", rows_a_task, rare=True, written=True))
    firsts = copies.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first"))
    later = spread_join(copies, firsts, ["uid"], "copies", rows_a_task=rows_a_task)
    return later.filter(F.col("place") != F.col("first")).select(*[F.col(f"place.{k}").alias(k) for k in keys])


def single_deliveries(stored: DataFrame, new: DataFrame | None = None, identifier: str = "event_id", order: list[str] | None = None, identity=uuid_bytes, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Whole records, one copy of each message of the stored and the new ones.

    Messages whose identifier occurs once pass directly, as do those without a UUID; of the repeated ones the first by
    ``order`` stays (nulls last; a record stored twice under one place is still one message); both results are united. All
    columns are kept, whatever their names. A first is a minimum, which combines on the map side, so that a hot identifier
    sends one row a task.
    """
    keyed = _keyed(stored, new, identifier, identity)
    repeated = _repeated(keyed)
    near, far = parted(keyed.filter(F.col("uid").isNotNull()), repeated, ["uid"])
    # few records, written since both parts read them
    near = cut(spread_join(near, repeated.withColumn("several", F.lit(True)), ["uid"], "copies", "left", rows_a_task, written=True))
    place = _ranked(order or ["kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset"])
    ranked = near.filter("several").groupBy("uid").agg(F.min_by("row", place).alias("row"))
    parts = [keyed.filter(F.col("uid").isNull()), far, near.filter("several IS NULL"), ranked]
    united = parts[0].select("row")
    for part in parts[1:]:
        united = united.unionByName(part.select("row"))
    return united.select("row.*")
