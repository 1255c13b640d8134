"""Queries on change capture: stock movements of bronze_event as changes of a snapshot of branch and product pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import change_failure, decoded, latest_changes, overlay, reconciled, restored
from ..registry import query
from ..session import table

ORDER = ["source_lsn", "kafka_topic", "kafka_partition", "kafka_offset"]
_CHANGES = """changes AS (
  SELECT payload->>'$.branch_id' AS branch_id, payload->>'$.product_id' AS product_id, TRY_CAST(payload->>'$.on_hand_after' AS BIGINT) AS units,
    CASE WHEN TRY_CAST(payload->>'$.on_hand_after' AS BIGINT) = 0 THEN 'd' WHEN payload->>'$.movement_type' = 'restock' THEN 'c' ELSE 'u' END AS op,
    TRY_CAST(payload->>'$.inventory_version_after' AS BIGINT) AS source_lsn, kafka_topic, kafka_partition, kafka_offset
  FROM (SELECT * FROM bronze_event WHERE event_type = 'inventory.quantity_changed' AND json_valid(payload)) WHERE payload->>'$.branch_id' IS NOT NULL AND payload->>'$.product_id' IS NOT NULL),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch_id, product_id ORDER BY source_lsn DESC NULLS LAST, kafka_topic DESC NULLS LAST, kafka_partition DESC, kafka_offset DESC) AS k FROM changes) WHERE k = 1),
base AS (SELECT branch_id, product_id, sum(fulfilled_units)::BIGINT AS units FROM demand_attempt WHERE branch_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2)"""
_CURRENT = f"""WITH {_CHANGES} SELECT b.branch_id, b.product_id, b.units FROM base AS b LEFT JOIN latest AS l ON b.branch_id = l.branch_id AND b.product_id = l.product_id WHERE l.op IS NULL
UNION ALL SELECT branch_id, product_id, units FROM latest WHERE op <> 'd'"""


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    moves = table(spark, folder, "bronze_event").filter("event_type = 'inventory.quantity_changed'")
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    units = field("on_hand_after").try_cast("long")
    op = F.when(units == 0, "d").when(field("movement_type") == "restock", "c").otherwise("u")
    columns = [field("branch_id").alias("branch_id"), field("product_id").alias("product_id"), units.alias("units"), op.alias("op"), field("inventory_version_after").try_cast("long").alias("source_lsn")]
    return moves.select(*columns, *ORDER[1:]).filter("branch_id IS NOT NULL AND product_id IS NOT NULL")


def _base(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "demand_attempt").filter("branch_id IS NOT NULL AND product_id IS NOT NULL")
    return rows.groupBy("branch_id", "product_id").agg(F.sum("fulfilled_units").alias("units"))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """The changes as connector messages: every second one wrapped in a payload."""
    changes = _changes(spark, folder)
    source = F.struct(F.lit("inventory").alias("schema"), F.lit("inventory_position").alias("table"), F.col("source_lsn").alias("lsn"))
    row = F.struct("branch_id", "product_id", "units")
    record = F.struct("op", source.alias("source"), F.when(F.col("op") == "d", row).alias("before"), F.when(F.col("op") != "d", row).alias("after"), F.lit(1_735_689_600_000).alias("ts_ms"))
    value = F.when(F.col("kafka_offset") % 2 == 0, F.to_json(F.struct(record.alias("payload")))).otherwise(F.to_json(record))
    return changes.select(F.to_json(F.struct("branch_id", "product_id")).alias("key_json"), value.alias("value"), *ORDER[1:])


@query(f"WITH {_CHANGES} SELECT op, 'inventory' AS source_schema, 'inventory_position' AS source_table, source_lsn, kafka_topic, kafka_partition, kafka_offset FROM changes")
def json_01_decoded_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change messages decoded, wrapped and bare ones alike."""
    return decoded(_messages(spark, folder)).select("op", "source_schema", "source_table", *ORDER)


@query(f"""WITH {_CHANGES} SELECT kafka_topic, kafka_partition, kafka_offset, CASE WHEN kafka_offset % 7 = 0 THEN 'null_value' WHEN kafka_offset % 7 = 1 THEN 'unsupported_operation'
  WHEN kafka_offset % 7 = 2 THEN 'source_table_mismatch' END AS change_error FROM changes""")
def flt_02_change_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule that each change fails, where values, operations and tables are spoiled by offset."""
    spoilt = lambda k: F.col("kafka_offset") % 7 == k
    value = F.when(spoilt(0), F.lit(None)).when(spoilt(1), F.regexp_replace("value", '"op":"[cud]"', '"op":null')).when(spoilt(2), F.replace("value", F.lit('"inventory_position"'), F.lit('"other"'))).otherwise(F.col("value"))
    messages = decoded(_messages(spark, folder).withColumn("value", value))
    return messages.select(*ORDER[1:], change_failure("inventory", ["inventory_position"]).alias("change_error"))


@query(f"WITH {_CHANGES} SELECT branch_id, product_id, units, op, source_lsn, kafka_topic, kafka_partition, kafka_offset FROM latest")
def wn_02_latest_change(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of each pair, without a window over its history."""
    return latest_changes(_changes(spark, folder), ["branch_id", "product_id"], ORDER)


@query(_CURRENT)
def stm_08_reconciled_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot brought up to date."""
    return reconciled(_base(spark, folder), _changes(spark, folder), ["branch_id", "product_id"], ORDER)


@query(_CURRENT)
def stm_09_current_state_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """The same state by merge on read, from change messages of which each was stored twice."""
    messages = decoded(_messages(spark, folder)).withColumn("event_id", F.sha2(F.concat_ws("|", "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string")), 256))
    stored = messages.withColumn("ingested_at", F.explode(F.array(F.lit(1), F.lit(2))))
    return overlay(_base(spark, folder), stored, ["branch_id", "product_id"], order=tuple(ORDER))


@query(f"WITH {_CHANGES} SELECT b.branch_id, b.product_id FROM base AS b WHERE NOT EXISTS (SELECT 1 FROM latest AS l WHERE l.branch_id = b.branch_id AND l.product_id = b.product_id)")
def jn_03_unchanged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the snapshot that no change touches: an anti join."""
    return _base(spark, folder).join(_changes(spark, folder).select("branch_id", "product_id"), ["branch_id", "product_id"], "left_anti").select("branch_id", "product_id")


@query("""SELECT demand_attempt_id, kind, epoch_us(created_at) AS created_micros, (created_at AT TIME ZONE 'UTC')::DATE::VARCHAR AS created_day, requested_units::BIGINT AS requested_units
FROM (SELECT demand_attempt_id, date_trunc('millisecond', created_at) AS created_at, requested_units, unnest(['text', 'millis', 'micros']) AS kind FROM demand_attempt WHERE created_at IS NOT NULL)""")
def cdc_t_restored_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamps as text, milli- and microseconds, days as numbers, and long integers, restored from JSON."""
    rows = table(spark, folder, "demand_attempt").filter("created_at IS NOT NULL").withColumn("created_at", F.date_trunc("millisecond", "created_at")).withColumn("kind", F.explode(F.array(*map(F.lit, ("text", "millis", "micros")))))
    stamp = F.when(F.col("kind") == "text", F.concat(F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).when(F.col("kind") == "millis", F.unix_millis("created_at").cast("string")).otherwise(F.unix_micros("created_at").cast("string"))
    day = F.floor(F.unix_micros("created_at") / F.lit(86_400_000_000)).cast("string")
    body = F.to_json(F.struct("demand_attempt_id", "kind", stamp.alias("created_at"), day.alias("created_day"), F.col("requested_units").cast("string").alias("requested_units")))
    schema = T.StructType([T.StructField("demand_attempt_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("created_day", T.DateType()), T.StructField("requested_units", T.LongType())])
    return rows.select(body.alias("body")).select(restored("body", schema).alias("row")).select("row.demand_attempt_id", "row.kind", F.unix_micros("row.created_at").alias("created_micros"), F.col("row.created_day").cast("string").alias("created_day"), "row.requested_units")
