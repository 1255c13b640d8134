"""Topics of a Kafka cluster as envelopes: streams, bounded ranges of offsets, and keyed messages to a topic.

The connector's jar must be on the class path; option names are those of the connector."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .offsets import Offsets, records_between

#: The connector's name; another one with the same options can stand in for it.
FORMAT = "kafka"
FIELDS = ["event_id", "event_type", "schema_version", "aggregate_type", "aggregate_id", "occurred_at", "recorded_at", "correlation_id", "causation_id"]


def envelopes(messages: DataFrame) -> DataFrame:
    """Messages in the columns of delivered envelopes; the value is the envelope's JSON. What it lacks is null."""
    body = F.col("value").cast("string")
    place = {"kafka_topic": "topic", "kafka_partition": "partition", "kafka_offset": "offset", "kafka_timestamp": "timestamp"}
    return messages.select(*[F.col(c).alias(n) for n, c in place.items()], F.col("key").cast("string").alias("kafka_key"), *[F.get_json_object(body, f"$.{f}").alias(f) for f in FIELDS], F.get_json_object(body, "$.payload").alias("payload"))


def stream(spark: SparkSession, servers: str, topics: list[str], records_a_batch: int = 2000, form: str = FORMAT) -> DataFrame:
    """A stream of topics from their first record on. Records that are gone before they were read stop it."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "includeHeaders": "true", "maxOffsetsPerTrigger": str(records_a_batch)}
    return envelopes(spark.readStream.format(form).options(**options).load())


def between(spark: SparkSession, servers: str, start: Offsets, end: Offsets, form: str = FORMAT) -> DataFrame:
    """The records of a range of offsets, ends exclusive: the same ones each time it is read."""
    records_between(start, end)
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(start), "startingOffsets": json.dumps(start), "endingOffsets": json.dumps(end), "includeHeaders": "true"}
    return envelopes(spark.read.format(form).options(**options).load())


def publish(messages: DataFrame, servers: str, topic: str, form: str = FORMAT) -> None:
    """Writes ``key`` and ``value`` to a topic; a task that is made again may send its messages again, under the same ids."""
    messages.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).write.format(form).options(**{"kafka.bootstrap.servers": servers, "topic": topic}).mode("append").save()
