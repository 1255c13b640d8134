"""Envelopes from a stream into stored records, valid and quarantined, with an account of every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import validated
from ..sources.offsets import write_json


def from_files(spark: SparkSession, folder: str, schema: T.StructType, files_a_batch: int = 16) -> DataFrame:
    """A stream of Parquet files as they come, in the columns of delivered envelopes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def drain(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Works off what is there and stops, or else goes on as records come; started again it goes on after them.

    Each micro-batch is judged and written in one pass to ``<folder>/records``, apart by outcome, and accounted for in
    ``<folder>/accounts``: the rows that came, and how many of them are valid and quarantined, which must add up. A batch
    that broke off is written again in place of itself, so each record is there once. The checkpoint lies in shared storage.
    """

    def take(batch: DataFrame, number: int) -> None:
        arrived, judged = Observation(), Observation()
        outcome = F.when(F.col("validation_error").isNull(), "valid").otherwise("quarantined")
        taken = validated(batch.observe(arrived, F.count(F.lit(1)).alias("rows"))).withColumn("outcome", outcome)
        counts = [F.count_if(F.col("outcome") == name).alias(name) for name in ("valid", "quarantined")]
        taken.observe(judged, *counts).write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/records/micro_batch={number}")
        account = {"micro_batch": number, **arrived.get, **judged.get}
        if account["rows"] != account["valid"] + account["quarantined"]:
            raise RuntimeError(f"records are missing: {account}")
        write_json(f"{folder}/accounts/{number}.json", account)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """(micro_batch, rows, valid, quarantined) of what drain() took."""
    return spark.read.schema("micro_batch long, rows long, valid long, quarantined long").option("multiLine", "true").json(f"{folder}/accounts")
