"""The calls of the Kafka connector against a stand-in, which takes and gives what the connector would."""

import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from ledgerloom.operators.events import validated
from ledgerloom.sources import kafka
from ledgerloom.streaming.bronze import drain

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module
NAME = "kafka_stand_in"
AT = dt.datetime(2025, 1, 1)


def message(topic, partition, offset):
    body = {"event_id": f"e{offset}", "event_type": "sale.units_fulfilled", "occurred_at": "2025-01-01T00:00:00Z", "payload": {"n": offset}}
    return b"k", json.dumps(body).encode(), topic, partition, offset, AT, 0


class Bounded(DataSourceReader):
    def __init__(self, options):
        self.start, self.end = json.loads(options["startingOffsets"]), json.loads(options["endingOffsets"])

    def partitions(self):
        return [InputPartition((t, int(p), n, self.end[t][p])) for t, own in self.start.items() for p, n in own.items()]

    def read(self, partition):
        topic, number, first, end = partition.value
        for offset in range(first, end):
            yield message(topic, number, offset)


class Endless(SimpleDataSourceStreamReader):
    def initialOffset(self):  # noqa: N802
        return {"offset": 0}

    def read(self, start):
        end = min(start["offset"] + 4, 10)
        return iter([message("t", 0, o) for o in range(start["offset"], end)]), {"offset": end}

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return iter([message("t", 0, o) for o in range(start["offset"], end["offset"])])

    def commit(self, end):
        pass


class Into(DataSourceWriter):
    def __init__(self, options):
        self.place = options["kafka.bootstrap.servers"]

    def write(self, rows):
        import uuid

        with open(f"{self.place}/{uuid.uuid4().hex}", "w") as out:
            out.writelines(json.dumps([r["key"], r["value"]]) + "\n" for r in rows)
        return WriterCommitMessage()


class StandIn(DataSource):
    @classmethod
    def name(cls):
        return "kafka_stand_in"

    def schema(self):
        return "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"

    def reader(self, schema):
        return Bounded(self.options)

    def simpleStreamReader(self, schema):  # noqa: N802
        assert self.options["subscribe"] == "t" and self.options["startingOffsets"] == "earliest"
        return Endless()

    def writer(self, schema, overwrite):
        assert self.options["topic"] == "out" and not overwrite
        return Into(self.options)


@pytest.fixture
def stand_in(spark):
    spark.dataSource.register(StandIn)


def test_a_range_of_offsets(spark, stand_in):
    start, end = {"a": {"0": 3, "1": 0}, "b": {"0": 5}}, {"a": {"0": 6, "1": 2}, "b": {"0": 5}}
    read = kafka.between(spark, "s", start, end, NAME)
    assert sorted((r["kafka_topic"], r["kafka_partition"], r["kafka_offset"], r["event_id"]) for r in read.collect()) == [("a", 0, 3, "e3"), ("a", 0, 4, "e4"), ("a", 0, 5, "e5"), ("a", 1, 0, "e0"), ("a", 1, 1, "e1")]
    row = read.first()
    assert row["kafka_key"] == "k" and row["correlation_id"] is None and json.loads(row["payload"]) == {"n": row["kafka_offset"]}
    assert validated(read).count() == 5
    with pytest.raises(ValueError):
        kafka.between(spark, "s", end, start, NAME)


def test_a_stream_of_topics_drains(spark, stand_in, tmp_path):
    place = str(tmp_path / "bronze")
    query = drain(kafka.stream(spark, "s", ["t"], form=NAME), place, str(tmp_path / "state"), available_now=False)
    try:
        query.processAllAvailable()
        import time

        until = time.time() + 60
        while spark.read.parquet(f"{place}/records").count() < 10 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(r["kafka_offset"] for r in spark.read.parquet(f"{place}/records").collect()) == list(range(10))


def test_messages_go_to_a_topic(spark, stand_in, tmp_path):
    kafka.publish(spark.createDataFrame([("a", "1", "x"), ("b", "2", "x")], "key string, value string, headers string"), str(tmp_path), "out", NAME)
    assert sorted(json.loads(line) for p in tmp_path.iterdir() for line in p.read_text().splitlines()) == [["a", "1"], ["b", "2"]]
