"""A ledger of handled messages: what is new, a repeat, or an id used again for something else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread_join


def against_ledger(incoming: DataFrame, ledger: DataFrame, message_id: str, digest: str, order: list[str]) -> DataFrame:
    """Incoming rows with ``status``: new, duplicate or conflict.

    An id that the ledger has with the same digest is a duplicate, with another one a conflict. Of rows with one id that is
    new, the first by ``order`` is new and the others are judged by its digest. A null id is never in the ledger and its
    rows are new each. The ledger has each id once.
    """
    place = F.struct(*[F.col(c) for c in order])
    keyed = incoming.withColumn("place", place)
    seen = keyed.filter(F.col(message_id).isNotNull()).groupBy(F.col(message_id).alias("ledger_id")).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("place", digest)).alias("first"))
    known = seen.join(ledger.select(F.col(message_id).alias("ledger_id"), F.col(digest).alias("ledger_digest")), "ledger_id", "left")
    looked_up = spread_join(keyed, known.withColumnRenamed("ledger_id", message_id), [message_id], "copies", "left")
    same = lambda column: F.when(F.col(digest).eqNullSafe(column), "duplicate").otherwise("conflict")
    status = F.when(F.col("ledger_digest").isNotNull(), same(F.col("ledger_digest"))).when(F.col(message_id).isNull() | (F.col("place") == F.col("first.place")), "new").otherwise(same(F.col(f"first.{digest}")))
    return looked_up.withColumn("status", status).drop("place", "first", "ledger_digest")
