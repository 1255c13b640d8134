from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.changes import change_failure, decoded, latest_changes, overlay, reconciled, restored
from ledgerloom.operators.events import sorted_out, typed, validated

A, B = "0001dd15-ec04-4eb8-af25-ae8046906f20", "ffff5180-7aa0-436c-98f8-0be183953f5d"
ENVELOPE = "event_id string, event_type string, schema_version string, aggregate_type string, aggregate_id string, occurred_at string, recorded_at string, correlation_id string, causation_id string, payload string, kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, kafka_key string"
GOOD = {
    "event_id": A, "event_type": "goods_receipt.received", "schema_version": "1.0", "aggregate_type": "goods_receipt", "aggregate_id": B, "occurred_at": "2025-01-01T00:00:00Z", "recorded_at": "2025-01-01T00:00:01+02:00", "correlation_id": A, "causation_id": None,
    "payload": f'{{"receipt_id":"{A}","purchase_order_id":"{A}","branch_id":"{A}","supplier_id":"{A}","line_count":2,"received_units":5}}', "kafka_topic": "x.procurement.v1", "kafka_partition": 0, "kafka_offset": 1, "kafka_timestamp": None, "kafka_key": B,
}
SPOILT = [
    ({}, None), ({"event_id": A + "\n"}, "invalid_event_id"), ({"event_id": None, "payload": None}, "invalid_event_id"), ({"event_type": "sale.units_returned"}, "unknown_event_type"), ({"event_type": None}, "unknown_event_type"), ({"kafka_topic": "x.sales.v1"}, "topic_event_type_mismatch"),
    ({"kafka_topic": None}, "topic_event_type_mismatch"), ({"schema_version": "2.0"}, "unsupported_schema_version"), ({"aggregate_type": "  "}, "invalid_aggregate_type"), ({"aggregate_id": "n/a", "kafka_key": "n/a"}, "invalid_aggregate_id"), ({"correlation_id": ""}, "invalid_correlation_id"),
    ({"causation_id": "x"}, "invalid_causation_id"), ({"causation_id": B}, None), ({"kafka_key": None}, "kafka_key_mismatch"), ({"occurred_at": "2025-01-01T00:00:00"}, "invalid_occurred_at"), ({"recorded_at": "2025-13-01T00:00:00Z"}, "invalid_recorded_at"), ({"payload": "[1]"}, "payload_not_object"),
    ({"payload": '{"a": '}, "payload_not_object"), ({"payload": None}, "payload_not_object"),
]


def envelopes(spark, changes):
    return spark.createDataFrame([tuple((GOOD | c).values()) for c in changes], ENVELOPE)


def test_the_first_failure_is_named_and_no_row_is_lost(spark):
    records = envelopes(spark, [c | {"kafka_offset": i} for i, (c, _) in enumerate(SPOILT)])
    found = {r["kafka_offset"]: r["validation_error"] for r in validated(records).collect()}
    assert found == {i: code for i, (_, code) in enumerate(SPOILT)}


def test_repeats_and_conflicts(spark, at):
    records = envelopes(spark, [
        {"kafka_offset": 1, "kafka_timestamp": at("2025-01-02 00:00:00")}, {"kafka_offset": 2, "kafka_timestamp": at("2025-01-01 00:00:00"), "recorded_at": "2025-02-02T00:00:00Z"},
        {"kafka_offset": 3, "event_id": B}, {"kafka_offset": 4, "event_id": B, "payload": "{}"}, {"kafka_offset": 5, "event_id": B}, {"kafka_offset": 6, "event_id": A[:-1] + "1"},
    ])
    found = {r["kafka_offset"]: r["disposition"] for r in sorted_out(records, ["kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset"]).collect()}
    more = records.unionByName(records.filter("kafka_offset = 1"))  # rows that validation would leave out count, but change nothing
    assert found == {r["kafka_offset"]: r["disposition"] for r in sorted_out(records, ["kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset"], more).collect()}
    assert found == {1: "duplicate", 2: "canonical", 3: "conflict", 4: "conflict", 5: "conflict", 6: "canonical"}


def test_typed_payloads(spark):
    bad = GOOD["payload"].replace('"received_units":5', '"received_units":"many"')
    found = {r["kafka_offset"]: (r["payload_error"], r["received_units"]) for r in typed(validated(envelopes(spark, [{"kafka_offset": 1}, {"kafka_offset": 2, "payload": bad}, {"kafka_offset": 3, "payload": GOOD["payload"].replace(A, "x", 1)}])), "goods_receipt.received").collect()}
    assert found == {1: (None, 5), 2: ("invalid_quantity", None), 3: ("invalid_identifier", 5)}


CHANGES = "k1 string, k2 string, units long, op string, lsn long, place int"


def test_latest_change_reconciled_and_repeatable(spark, rows):
    base = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", None, 3)], "k1 string, k2 string, units long")
    changes = spark.createDataFrame([("a", "x", 10, "u", 5, 1), ("a", "x", 11, "u", 5, 2), ("a", "x", 9, "u", None, 3), ("b", "x", None, "d", 1, 1), ("d", "y", 4, "c", 1, 1), ("d", "y", None, "d", 2, 1), ("d", "y", 6, "c", 3, 1), ("e", "z", None, "d", 1, 1)], CHANGES)
    keys, order = ["k1", "k2"], ["lsn", "place"]
    assert rows(latest_changes(changes, keys, order), "k1", "units", "op") == [("a", 11, "u"), ("b", None, "d"), ("d", 6, "c"), ("e", None, "d")]
    once = reconciled(base, changes, keys, order)
    assert rows(once) == [("a", "x", 11), ("c", None, 3), ("d", "y", 6)]
    assert rows(reconciled(once, changes, keys, order)) == rows(once), "a second run changes nothing"
    assert rows(reconciled(base, changes.limit(0), keys, order)) == rows(base)


def test_decoded_wrapped_and_bare_with_failures(spark):
    bare = '{"op":"u","source":{"schema":"s","table":"t","lsn":7},"after":{"a":1},"ts_ms":3}'
    messages = [bare, f'{{"payload":{bare}}}', bare.replace("7", '"x"'), bare.replace('"u"', "null"), bare.replace('"s"', '"o"'), bare.replace('"t"', "null", 1), None, "no json", bare.replace('"after":{"a":1},', ""), bare.replace('"u"', '"d"').replace('"after"', '"before"')]
    found = decoded(spark.createDataFrame(list(enumerate(messages)), "i int, value string")).withColumn("error", change_failure("s", ["t"])).orderBy("i").collect()
    assert [r["source_lsn"] for r in found][:3] == [7, 7, None]
    assert [r["error"] for r in found] == [None, None, None, "unsupported_operation", "source_schema_mismatch", "source_table_mismatch", "null_value", "unsupported_operation", "missing_row", None]


@pytest.mark.parametrize(("kind", "text", "value"), [
    (T.DateType(), '"2025-01-02"', date(2025, 1, 2)), (T.DateType(), "20089", date(2025, 1, 1)), (T.LongType(), '"x"', None), (T.LongType(), "12", 12), (T.BooleanType(), "true", True),
    (T.StringType(), '"a"', "a"), (T.BinaryType(), '"YWI="', bytearray(b"ab")), (T.DecimalType(10, 2), '"1.50"', None), (T.DoubleType(), "1.5", 1.5), (T.DateType(), "null", None),
])
def test_restored_scalars(spark, kind, text, value):
    schema = T.StructType([T.StructField("f", kind)])
    found = spark.createDataFrame([(f'{{"f":{text}}}',)], "j string").select(restored("j", schema).alias("r")).select("r.f").first()[0]
    assert found == value or (isinstance(kind, T.DecimalType) and str(found) == "1.50")


def test_restored_moments(spark):
    schema = T.StructType([T.StructField("f", T.TimestampType())])
    texts = ['"2025-01-01T00:00:00Z"', "1735689600000", "1735689600000000"]
    found = spark.createDataFrame([(f'{{"f":{t}}}',) for t in texts], "j string").select(F.unix_micros(restored("j", schema)["f"]).alias("m")).collect()
    assert {r["m"] for r in found} == {1_735_689_600_000_000}


def test_overlay_drops_repeated_deltas(spark, rows):
    base = spark.createDataFrame([(1, "old"), (2, "kept"), (3, "gone")], "k int, v string")
    delta = lambda e, k, op, after, lsn, at: (e, f'{{"k":{k}}}', op, after, lsn, 0, lsn, at)
    deltas = spark.createDataFrame([delta("e1", 1, "u", '{"k":1,"v":"new"}', 5, 1), delta("e1", 1, "u", '{"k":1,"v":"new"}', 5, 2), delta("e2", 3, "d", None, 6, 1), delta("e3", 4, "c", '{"k":"4","v":"made"}', 7, 1), delta("e4", 1, "u", '{"k":1,"v":"older"}', 4, 9)], "event_id string, key_json string, op string, after_json string, source_lsn long, kafka_partition int, kafka_offset long, ingested_at int")
    assert rows(overlay(base, deltas, ["k"])) == [(1, "new"), (2, "kept"), (4, "made")]
