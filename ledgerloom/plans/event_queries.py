"""Queries on event envelopes, over all of bronze_event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import name_uuid
from ..operators.event_builders import EVENTS, sale_events
from ..operators.events import EVENT_TYPES, sorted_out, typed, validated
from ..registry import query
from ..session import table

PLACE = ["kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset"]
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_MOMENT = r"^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)\s*$"
_READ = lambda c: f"CASE WHEN regexp_matches({c}, '{_MOMENT}') THEN TRY_CAST({c} AS TIMESTAMPTZ) END"
_KNOWN = " ".join(f"WHEN '{k}' THEN '{d}'" for k, (d, _) in EVENT_TYPES.items())
_VALIDATED = f"""validated AS (SELECT *, CASE
  WHEN event_id IS NULL OR NOT regexp_matches(event_id, '{_UUID}') THEN 'invalid_event_id'
  WHEN (CASE event_type {_KNOWN} END) IS NULL THEN 'unknown_event_type'
  WHEN regexp_extract(kafka_topic, '([^.]+)\\.v\\d+$', 1) IS DISTINCT FROM (CASE event_type {_KNOWN} END) THEN 'topic_event_type_mismatch'
  WHEN schema_version IS DISTINCT FROM '1.0' THEN 'unsupported_schema_version'
  WHEN aggregate_type IS NULL OR length(trim(aggregate_type)) = 0 THEN 'invalid_aggregate_type'
  WHEN aggregate_id IS NULL OR NOT regexp_matches(aggregate_id, '{_UUID}') THEN 'invalid_aggregate_id'
  WHEN correlation_id IS NULL OR NOT regexp_matches(correlation_id, '{_UUID}') THEN 'invalid_correlation_id'
  WHEN causation_id IS NOT NULL AND NOT regexp_matches(causation_id, '{_UUID}') THEN 'invalid_causation_id'
  WHEN kafka_key IS DISTINCT FROM aggregate_id THEN 'kafka_key_mismatch'
  WHEN {_READ('occurred_at')} IS NULL THEN 'invalid_occurred_at'
  WHEN {_READ('recorded_at')} IS NULL THEN 'invalid_recorded_at'
  WHEN payload IS NULL OR NOT json_valid(payload) OR NOT regexp_matches(payload, '^\\s*\\{{') THEN 'payload_not_object' END AS validation_error,
  {_READ('occurred_at')} AS occurred_ts FROM bronze_event)"""
_SORTED = f"""{_VALIDATED}, hashed AS (SELECT *, sha256(concat_ws('||', coalesce(event_id, ''), coalesce(event_type, ''), coalesce(schema_version, ''), coalesce(aggregate_type, ''), coalesce(aggregate_id, ''),
    coalesce(occurred_at, ''), coalesce(correlation_id, ''), coalesce(causation_id, ''), coalesce(payload, ''))) AS meaning_sha256 FROM validated WHERE validation_error IS NULL),
sorted AS (SELECT *, CASE WHEN min(meaning_sha256) OVER (PARTITION BY event_id) <> max(meaning_sha256) OVER (PARTITION BY event_id) THEN 'conflict'
  WHEN row_number() OVER (PARTITION BY event_id ORDER BY kafka_timestamp, kafka_topic, kafka_partition, kafka_offset) > 1 THEN 'duplicate' ELSE 'canonical' END AS disposition FROM hashed)"""


@query(f"WITH {_VALIDATED} SELECT kafka_topic, kafka_partition, kafka_offset, validation_error, ((occurred_ts AT TIME ZONE 'UTC')::DATE)::VARCHAR AS event_date FROM validated")
def flt_01_validation_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with the first rule of the envelope that it fails."""
    return validated(table(spark, folder, "bronze_event")).select("kafka_topic", "kafka_partition", "kafka_offset", "validation_error", F.col("event_date").cast("string").alias("event_date"))


@query(f"WITH {_VALIDATED} SELECT count(*) AS input_rows, count(*) FILTER (validation_error IS NULL) AS valid_rows, count(validation_error) AS quarantined_rows FROM validated")
def flt_04_valid_and_quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """The split's row counts in one pass; valid and quarantined rows add up to the input."""
    return validated(table(spark, folder, "bronze_event")).agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("validation_error").isNull()).alias("valid_rows"), F.count("validation_error").alias("quarantined_rows"))


def _sorted(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "bronze_event")
    return sorted_out(validated(records).filter("validation_error IS NULL"), PLACE, records)


@query(f"WITH {_SORTED} SELECT event_id, meaning_sha256, kafka_topic, kafka_partition, kafka_offset, disposition FROM sorted")
def stm_10_event_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """Valid events as canonical, duplicate or conflict."""
    return _sorted(spark, folder).select("event_id", "meaning_sha256", "kafka_topic", "kafka_partition", "kafka_offset", "disposition")


_FIELDS = {"sale.units_fulfilled": ("requested_quantity", "lost_quantity"), "inventory.quantity_changed": ("on_hand_after", "quantity_delta"), "inventory.reorder_required": ("recommended_reorder_quantity", "reorder_point"), "purchase_order.created": ("ordered_units", "line_count"), "goods_receipt.received": ("received_units", "line_count"), "restock.applied": ("quantity", "on_hand_after")}


@query(f"WITH {_SORTED} " + " UNION ALL ".join(f"SELECT event_id, event_type, TRY_CAST(payload->>'$.{a}' AS INTEGER) AS first_units, TRY_CAST(payload->>'$.{b}' AS INTEGER) AS second_units FROM sorted WHERE disposition = 'canonical' AND event_type = '{k}'" for k, (a, b) in _FIELDS.items()))
def prj_06_typed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical events of every type with two fields of their typed payloads, united."""
    canonical = _sorted(spark, folder).filter("disposition = 'canonical'")
    parts = [typed(canonical, kind).select("event_id", "event_type", F.col(a).alias("first_units"), F.col(b).alias("second_units")) for kind, (a, b) in _FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


_INT = "TRY_CAST(payload->>'$.{}' AS INTEGER)"
_SIGNS = {
    "sale.units_fulfilled": [("invalid_quantity", "{requested_quantity} > 0 AND {fulfilled_quantity} > 0 AND {lost_quantity} >= 0"), ("quantities_disagree", "{fulfilled_quantity} + {lost_quantity} = {requested_quantity}")],
    "inventory.quantity_changed": [("invalid_quantity", "{quantity_delta} <> 0 AND {on_hand_before} >= 0 AND {on_hand_after} >= 0"), ("quantities_disagree", "{on_hand_before} + {quantity_delta} = {on_hand_after}")],
    "inventory.reorder_required": [("invalid_quantity", "{available_quantity} >= 0 AND {reorder_point} >= 0 AND {target_stock_level} > 0 AND {recommended_reorder_quantity} > 0")],
    "purchase_order.created": [("invalid_date", "TRY_CAST(payload->>'$.expected_delivery_on' AS DATE) IS NOT NULL"), ("invalid_quantity", "{line_count} > 0 AND {ordered_units} > 0")],
    "goods_receipt.received": [("invalid_quantity", "{line_count} > 0 AND {received_units} > 0")],
    "restock.applied": [("invalid_quantity", "{quantity} > 0 AND {on_hand_before} >= 0 AND {on_hand_after} >= 0"), ("quantities_disagree", "{on_hand_before} + {quantity} = {on_hand_after}")],
}


def _payload_error(kind: str) -> str:
    fields = [c.split()[0] for c in EVENT_TYPES[kind][1].split(", ")]
    ids = " AND ".join(f"regexp_matches(payload->>'$.{f}', '{_UUID}')" for f in fields if f.endswith("_id"))
    rules = [("invalid_identifier", ids), *((code, rule.format(**{f: _INT.format(f) for f in fields})) for code, rule in _SIGNS[kind])]
    return "CASE " + " ".join(f"WHEN ({rule}) IS NOT TRUE THEN '{code}'" for code, rule in rules) + " END"


@query(f"WITH {_SORTED} " + " UNION ALL ".join(f"SELECT event_type, {_payload_error(kind)} AS payload_error, count(*) AS events FROM sorted WHERE disposition = 'canonical' AND event_type = '{kind}' GROUP BY 1, 2" for kind in EVENT_TYPES))
def flt_03_payload_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical events by type and the first rule that their payload fails."""
    canonical = _sorted(spark, folder).filter("disposition = 'canonical'")
    parts = [typed(canonical, kind).groupBy("event_type", "payload_error").agg(F.count(F.lit(1)).alias("events")) for kind in EVENT_TYPES]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT kafka_topic, kafka_partition, count(*) AS records, min(kafka_offset) AS first_offset, max(kafka_offset) + 1 AS end_offset, (max(kafka_offset) - min(kafka_offset) + 1 - count(*))::BIGINT AS missing_offsets FROM bronze_event GROUP BY 1, 2")
def stm_02_source_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Per partition the range of offsets, and how many of it aren't there."""
    bounds = table(spark, folder, "bronze_event").groupBy("kafka_topic", "kafka_partition").agg(F.count(F.lit(1)).alias("records"), F.min("kafka_offset").alias("first_offset"), (F.max("kafka_offset") + 1).alias("end_offset"))
    return bounds.withColumn("missing_offsets", F.col("end_offset") - F.col("first_offset") - F.col("records"))


@query("SELECT kafka_topic, kafka_partition, kafka_offset, sha256(concat_ws('|', kafka_topic, kafka_partition::VARCHAR, kafka_offset::VARCHAR)) AS record_sha256 FROM bronze_event")
def hash_03_record_identity(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each record's place."""
    place = F.concat_ws("|", "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string"))
    return table(spark, folder, "bronze_event").select("kafka_topic", "kafka_partition", "kafka_offset", F.sha2(place, 256).alias("record_sha256"))


@query("""WITH d AS (SELECT DISTINCT aggregate_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')::BLOB || encode(aggregate_id)) AS h FROM bronze_event WHERE aggregate_id IS NOT NULL)
SELECT aggregate_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4 + 1)::INT, 1) || h[18:20] || '-' || h[21:32] AS name_uuid FROM d""")
def hash_06_name_uuids(spark: SparkSession, folder: str) -> DataFrame:
    """Version 5 UUIDs of the aggregates' names."""
    names = table(spark, folder, "bronze_event").select("aggregate_id").filter("aggregate_id IS NOT NULL").distinct()
    return names.select("aggregate_id", name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("aggregate_id")).alias("name_uuid"))


@query("""SELECT kafka_topic, kafka_partition, kafka_offset, base64(encode(payload)) AS payload_base64, sha256(payload) AS payload_sha256 FROM bronze_event
WHERE payload IS NOT NULL AND (NOT json_valid(payload) OR NOT regexp_matches(payload, '^\\s*\\{'))""")
def snk_13_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads that are no objects as dead letters: encoded, hashed, with their place."""
    records = table(spark, folder, "bronze_event").filter(F.col("payload").isNotNull() & ~(F.col("payload").rlike(r"^\s*\{") & F.get_json_object("payload", "$").isNotNull()))
    return records.select("kafka_topic", "kafka_partition", "kafka_offset", F.regexp_replace(F.base64(F.encode("payload", "UTF-8")), r"\s", "").alias("payload_base64"), F.sha2("payload", 256).alias("payload_sha256"))


# as JSON the fields that aren't null, in order
_JSON = lambda fields: "'{' || concat_ws(',', " + ", ".join(f"'\"{name}\":' || {made}" for name, made in fields) + ") || '}'"
_TEXT = lambda c: f"'\"' || {c} || '\"'"
_SALE_PAYLOAD = _JSON([("demand_id", _TEXT("demand_attempt_id")), ("basket_id", _TEXT("linked_sale_id")), ("branch_id", _TEXT("branch_id")), ("product_id", _TEXT("product_id")), ("requested_quantity", "requested_units::VARCHAR"), ("fulfilled_quantity", "fulfilled_units::VARCHAR"), ("lost_quantity", "lost_units::VARCHAR"), ("fulfillment_status", _TEXT("outcome"))])
_SALE_VALUE = _JSON([("event_id", _TEXT("own")), ("event_type", "'\"sale.units_fulfilled\"'"), ("aggregate_type", "'\"demand_line\"'"), ("aggregate_id", _TEXT("demand_attempt_id")), ("occurred_at", _TEXT("strftime(transaction_ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z'")), ("correlation_id", _TEXT("demand_attempt_id")), ("payload", _SALE_PAYLOAD)])


@query(f"""WITH d AS (SELECT *, sha1(unhex('{EVENTS.replace("-", "")}')::BLOB || encode('sale.units_fulfilled|' || demand_attempt_id)) AS h FROM demand_attempt WHERE demand_attempt_id IS NOT NULL AND fulfilled_units > 0),
e AS (SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4 + 1)::INT, 1) || h[18:20] || '-' || h[21:32] AS own FROM d)
SELECT demand_attempt_id AS key, {_SALE_VALUE} AS value, '{{"schema_version":"1.0"}}' AS headers FROM e""")
def snk_12_keyed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Demand attempts as keyed messages: key, value as JSON with its event id and correlation, and headers."""
    renamed = {"demand_id": "demand_attempt_id", "basket_id": "linked_sale_id", "occurred_at": "transaction_ts", "requested_quantity": "requested_units", "fulfilled_quantity": "fulfilled_units", "lost_quantity": "lost_units", "fulfillment_status": "outcome"}
    rows = table(spark, folder, "demand_attempt").filter("demand_attempt_id IS NOT NULL")
    # the table has no channel
    events = sale_events(rows.select("branch_id", "product_id", F.lit(None).cast("string").alias("channel"), *[F.col(c).alias(n) for n, c in renamed.items()]))
    return events.select(F.col("aggregate_id").alias("key"), F.to_json(F.struct(*[c for c in events.columns if c != "schema_version"])).alias("value"), F.to_json(F.struct("schema_version")).alias("headers"))


@query(f"""WITH {_SORTED} SELECT event_type, ((occurred_ts AT TIME ZONE 'UTC')::DATE)::VARCHAR AS event_date, count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT aggregate_id) AS aggregates FROM sorted GROUP BY 1, 2""")
def ag_02_distinct_by_type_and_day(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct events and distinct aggregates per type and day."""
    groups = _sorted(spark, folder).groupBy("event_type", F.col("event_date").cast("string").alias("event_date"))
    return groups.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"), F.count_distinct("aggregate_id").alias("aggregates"))
