"""Event envelopes: validation with the first failure named, quarantine, repeats and conflicts, typed payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import utc_day, zoned_moment
from ..session import cut
from .spread import parted, spread_join

#: The event types with the domain of their topics and the columns of their payloads.
EVENT_TYPES = {
    "sale.units_fulfilled": ("sales", "demand_id string, basket_id string, branch_id string, product_id string, channel string, requested_quantity int, fulfilled_quantity int, lost_quantity int, fulfillment_status string, pricing_status string"),
    "inventory.quantity_changed": ("inventory", "movement_id string, branch_id string, product_id string, movement_type string, reference_id string, quantity_delta int, on_hand_before int, on_hand_after int, inventory_version_after int"),
    "inventory.reorder_required": ("inventory", "branch_id string, product_id string, available_quantity int, reorder_point int, target_stock_level int, recommended_reorder_quantity int, inventory_version int"),
    "purchase_order.created": ("procurement", "purchase_order_id string, procurement_cycle_id string, branch_id string, supplier_id string, expected_delivery_on string, line_count int, ordered_units int, monetary_values_generated boolean"),
    "goods_receipt.received": ("procurement", "receipt_id string, purchase_order_id string, branch_id string, supplier_id string, line_count int, received_units int"),
    "restock.applied": ("procurement", "movement_id string, receipt_id string, purchase_order_id string, branch_id string, product_id string, quantity int, on_hand_before int, on_hand_after int, inventory_version_after int"),
}
#: Fixed value: a UUID in its usual notation.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\z"


@dataclass(frozen=True)
class Check:
    """A named rule; a row fails it unless ``holds`` is true (null fails)."""

    code: str
    holds: Column


def first_failure(checks: list[Check]) -> Column:
    """The code of the first rule that a row fails, in order; null for a row that fails none."""
    code = F.lit(None).cast("string")
    for check in reversed(checks):
        code = F.when(~F.coalesce(check.holds, F.lit(False)), F.lit(check.code)).otherwise(code)
    return code


def _is_object(text: str) -> Column:
    # a parse that fails gives null; arrays and scalars don't begin with a brace
    return F.col(text).rlike(r"^\s*\{") & F.get_json_object(text, "$").isNotNull()


def envelope_checks() -> list[Check]:
    """The rules of an event envelope in the order in which failures are named. The codes are fixed values."""
    uuid = lambda c: F.col(c).rlike(UUID)
    domain = F.regexp_extract("kafka_topic", r"([^.]+)\.v\d+$", 1)
    expected = F.lit(None).cast("string")
    for kind, (of, _) in EVENT_TYPES.items():
        expected = F.when(F.col("event_type") == kind, of).otherwise(expected)
    return [
        Check("invalid_event_id", uuid("event_id")),
        Check("unknown_event_type", expected.isNotNull()),
        Check("topic_event_type_mismatch", domain == expected),
        Check("unsupported_schema_version", F.col("schema_version") == "1.0"),
        Check("invalid_aggregate_type", F.length(F.trim("aggregate_type")) > 0),
        Check("invalid_aggregate_id", uuid("aggregate_id")),
        Check("invalid_correlation_id", uuid("correlation_id")),
        Check("invalid_causation_id", F.col("causation_id").isNull() | uuid("causation_id")),
        Check("kafka_key_mismatch", F.col("kafka_key") == F.col("aggregate_id")),
        Check("invalid_occurred_at", zoned_moment("occurred_at").isNotNull()),
        Check("invalid_recorded_at", zoned_moment("recorded_at").isNotNull()),
        Check("payload_not_object", _is_object("payload")),
    ]


def validated(records: DataFrame) -> DataFrame:
    """Records with ``validation_error`` (null: valid), ``occurred_ts``, ``recorded_ts`` and ``event_date`` (UTC).

    Every row comes out, so valid and invalid ones add up to the input. Nulls fail their rule, save a null causation_id.
    """
    moments = records.withColumns({"validation_error": first_failure(envelope_checks()), "occurred_ts": zoned_moment("occurred_at"), "recorded_ts": zoned_moment("recorded_at")})
    return moments.withColumn("event_date", utc_day("occurred_ts"))


def meaning_hash() -> Column:
    """SHA-256 of what an event says, without when it was recorded."""
    parts = ["event_id", "event_type", "schema_version", "aggregate_type", "aggregate_id", "occurred_at", "correlation_id", "causation_id", "payload"]
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(p), F.lit("")) for p in parts]), 256)


def sorted_out(valid: DataFrame, order: list[str], among: DataFrame | None = None) -> DataFrame:
    """Valid events with ``meaning_sha256`` and ``disposition``: canonical, duplicate or conflict.

    An event_id with more than one meaning is a conflict, with all of its rows; else its first row by ``order`` (unique in
    the table) is canonical and the others are duplicates. Identifiers are counted first: events that are alone are
    canonical; only the meanings of repeated ones are compared and their rows ranked. Counts, firsts and meanings combine
    on the map side, and a hot event_id is spread over tasks when its rows are looked up. Where ``among`` is given, which
    holds all rows of ``valid``, its identifiers are counted, so that nothing has to be validated for that.
    """
    repeated = cut((valid if among is None else among).groupBy("event_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    near, far = parted(valid, repeated, ["event_id"])
    near = cut(spread_join(near, repeated.withColumn("several", F.lit(True)), ["event_id"], "copies", "left", written=True))
    alone = far.unionByName(near.filter("several IS NULL").drop("several")).withColumns({"meaning_sha256": meaning_hash(), "disposition": F.lit("canonical")})
    groups = near.filter("several").drop("several").withColumns({"meaning_sha256": meaning_hash(), "place": F.struct(*order)})
    seen = groups.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"), (F.min("meaning_sha256") != F.max("meaning_sha256")).alias("differs"), F.min("place").alias("first"))
    kind = F.when(F.col("differs"), "conflict").when(F.col("place") != F.col("first"), "duplicate").otherwise("canonical")
    judged = spread_join(groups, seen, ["event_id"], "copies").withColumn("disposition", kind).drop("place", "differs", "first")
    return alone.unionByName(judged)


def payload_checks(event_type: str) -> list[Check]:
    """What a typed payload must satisfy beside its types: identifiers, signs and sums."""
    p = lambda c: F.col(f"typed.{c}")
    ids = [Check("invalid_identifier", p(c.split()[0]).rlike(UUID)) for c in EVENT_TYPES[event_type][1].split(", ") if c.split()[0].endswith("_id")]
    own = {
        "sale.units_fulfilled": [Check("invalid_quantity", (p("requested_quantity") > 0) & (p("fulfilled_quantity") > 0) & (p("lost_quantity") >= 0)), Check("quantities_disagree", p("fulfilled_quantity") + p("lost_quantity") == p("requested_quantity"))],
        "inventory.quantity_changed": [Check("invalid_quantity", (p("quantity_delta") != 0) & (p("on_hand_before") >= 0) & (p("on_hand_after") >= 0)), Check("quantities_disagree", p("on_hand_before") + p("quantity_delta") == p("on_hand_after"))],
        "inventory.reorder_required": [Check("invalid_quantity", (p("available_quantity") >= 0) & (p("reorder_point") >= 0) & (p("target_stock_level") > 0) & (p("recommended_reorder_quantity") > 0))],
        "purchase_order.created": [Check("invalid_date", p("expected_delivery_on").try_cast("date").isNotNull()), Check("invalid_quantity", (p("line_count") > 0) & (p("ordered_units") > 0))],
        "goods_receipt.received": [Check("invalid_quantity", (p("line_count") > 0) & (p("received_units") > 0))],
        "restock.applied": [Check("invalid_quantity", (p("quantity") > 0) & (p("on_hand_before") >= 0) & (p("on_hand_after") >= 0)), Check("quantities_disagree", p("on_hand_before") + p("quantity") == p("on_hand_after"))],
    }
    return ids + own[event_type]


def typed(events: DataFrame, event_type: str) -> DataFrame:
    """Events of a type with their payload's columns beside the envelope's, and ``payload_error``.

    A field that is missing or of another type is null and fails the rules that name it.
    """
    own = events.filter(F.col("event_type") == event_type).withColumn("typed", F.from_json("payload", EVENT_TYPES[event_type][1]))
    envelope = ["event_id", "event_type", "aggregate_id", "occurred_ts", "recorded_ts", "event_date", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp"]
    return own.withColumn("payload_error", first_failure(payload_checks(event_type))).select(*envelope, "payload_error", "typed.*")
