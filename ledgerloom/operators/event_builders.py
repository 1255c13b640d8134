"""Domain events from rows, linked by correlation and cause, and decisions of models from their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import name_uuid
from .events import Check, first_failure

#: The namespaces of event and inventory identifiers.
EVENTS, INVENTORY = "e51c03ea-ecce-44d4-a4d6-2a6674d66781", "a9919ca4-bf2c-4776-bf9e-0f078634bf7d"
#: Topics, without the first part that names the installation, with their model and the kind of its decisions.
DECISIONS = {
    "ml.stockout_predictions": ("stockout_risk", "STOCKOUT"),
    "ml.reorder_recommendations": ("reorder_recommendation", "REORDER"),
    "ml.expiry_alerts": ("expiry_slow_moving_risk", "EXPIRY"),
}

_BALANCE = ["on_hand_before", "on_hand_after", "inventory_version_after"]


def event_id(kind: str, *identity: str | Column) -> Column:
    """The version 5 UUID of a kind of event and what identifies its row; null if a part is null."""
    name = F.lit(kind)
    for part in identity:
        name = F.concat(name, F.lit("|"), F.col(part) if isinstance(part, str) else part)
    return name_uuid(EVENTS, name)


# the payload is a struct: as JSON, events of all kinds can be united
def _event(rows: DataFrame, kind: str, of: str, own: Column, aggregate: Column, moment: str, correlation: str, cause: Column | None, payload: list[str | Column]) -> DataFrame:
    return rows.select(
        own.alias("event_id"), F.lit(kind).alias("event_type"), F.lit("1.0").alias("schema_version"), F.lit(of).alias("aggregate_type"), aggregate.alias("aggregate_id"), F.col(moment).alias("occurred_at"),
        F.col(correlation).alias("correlation_id"), (F.lit(None).cast("string") if cause is None else cause).alias("causation_id"), F.struct(*payload).alias("payload"),
    )


def _inventory() -> Column:
    return name_uuid(INVENTORY, F.concat("branch_id", F.lit("|"), "product_id"))


def sale_events(rows: DataFrame) -> DataFrame:
    """A sale for each demand of which something was fulfilled, correlated by the demand."""
    payload = ["demand_id", "basket_id", "branch_id", "product_id", "channel", "requested_quantity", "fulfilled_quantity", "lost_quantity", "fulfillment_status"]
    return _event(rows.filter("fulfilled_quantity > 0"), "sale.units_fulfilled", "demand_line", event_id("sale.units_fulfilled", "demand_id"), F.col("demand_id"), "occurred_at", "demand_id", None, payload)


def _changed(rows: DataFrame, own: Column, movement: str, reference: str, correlation: str, cause: Column) -> DataFrame:
    payload = ["movement_id", "branch_id", "product_id", F.lit(movement).alias("movement_type"), "quantity_delta", *_BALANCE, F.col(reference).alias("reference_id")]
    return _event(rows, "inventory.quantity_changed", "inventory_item", own, _inventory(), "occurred_at", correlation, cause, payload)


def sale_inventory_events(rows: DataFrame) -> DataFrame:
    """The movement of stock that a sale caused."""
    return _changed(rows, event_id("inventory.quantity_changed", "movement_id"), "sale", "demand_id", "demand_id", event_id("sale.units_fulfilled", "demand_id"))


def reorder_events(rows: DataFrame) -> DataFrame:
    """A reorder, caused by the movement of stock in ``movement_id`` if there is one."""
    payload = ["branch_id", "product_id", "available_quantity", "reorder_point", "target_stock_level", "recommended_reorder_quantity", "inventory_version"]
    return _event(rows, "inventory.reorder_required", "inventory_item", event_id("inventory.reorder_required", "demand_id", "product_id"), _inventory(), "occurred_at", "demand_id", event_id("inventory.quantity_changed", "movement_id"), payload)


def purchase_order_events(rows: DataFrame) -> DataFrame:
    """A purchase order, correlated by its procurement cycle."""
    payload = ["purchase_order_id", "procurement_cycle_id", "branch_id", "supplier_id", "expected_delivery_on", "line_count", "ordered_units"]
    return _event(rows, "purchase_order.created", "purchase_order", event_id("purchase_order.created", "purchase_order_id"), F.col("purchase_order_id"), "ordered_at", "procurement_cycle_id", None, payload)


def receipt_events(rows: DataFrame) -> DataFrame:
    """A receipt of goods, caused by its order; rows have the order's procurement cycle."""
    payload = ["receipt_id", "purchase_order_id", "branch_id", "supplier_id", "line_count", "received_units"]
    return _event(rows, "goods_receipt.received", "goods_receipt", event_id("goods_receipt.received", "receipt_id"), F.col("receipt_id"), "received_at", "procurement_cycle_id", event_id("purchase_order.created", "purchase_order_id"), payload)


def restock_events(rows: DataFrame) -> DataFrame:
    """A restock, caused by the receipt; rows have the order's procurement cycle."""
    payload = ["movement_id", "receipt_id", "purchase_order_id", "branch_id", "product_id", F.col("quantity_delta").alias("quantity"), *_BALANCE]
    return _event(rows, "restock.applied", "inventory_item", event_id("restock.applied", "movement_id"), _inventory(), "occurred_at", "procurement_cycle_id", event_id("goods_receipt.received", "receipt_id"), payload)


def restock_inventory_events(rows: DataFrame) -> DataFrame:
    """The movement of stock that a restock caused."""
    return _changed(rows, event_id("inventory.quantity_changed", F.lit("restock"), "movement_id"), "restock", "receipt_id", "procurement_cycle_id", event_id("restock.applied", "movement_id"))


def decided(messages: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Messages with the columns of their model's decision and ``decision_error``, the first rule that they fail.

    Texts are trimmed where required; a null or blank one is missing. Units are whole, rounded up, 0 if none are asked for.
    """
    field = lambda name: F.get_json_object(value, f"$.{name}")
    required = lambda name: F.when(F.trim(field(name)) != "", F.trim(field(name)))

    def number(name: str) -> Column:
        read = F.trim(field(name)).try_cast("double")
        return F.when(~F.isnan(read) & (F.abs(read) < float("inf")), read)

    of, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    own = F.regexp_extract(topic, r"^[^.]+\.(.+)$", 1)
    for name, (model, decision) in DECISIONS.items():
        of, kind = F.when(own == name, model).otherwise(of), F.when(own == name, decision).otherwise(kind)
    pair = F.concat(required("branch_id"), F.lit("|"), required("product_id"))
    entity = F.when(of == "expiry_slow_moving_risk", required("batch_id")).otherwise(pair)
    flag = lambda name: ~F.coalesce(F.lower(field(name)), F.lit("false")).isin("false", "", "0", "0.0", "[]", "{}")
    wanted = F.coalesce(F.greatest(F.lit(0), F.ceil(number("recommended_order_units"))), F.lit(0))
    units = F.when(of == "reorder_recommendation", wanted)
    action = flag("action_required") & (F.coalesce(units, F.lit(1)) > 0)
    named = F.upper(F.when(field("severity") != "", field("severity")))
    severity = F.when(of == "stockout_risk", F.coalesce(named, F.lit("NORMAL"))).when(~action, "NORMAL").when(of == "expiry_slow_moving_risk", "HIGH").otherwise("WATCH")
    error = first_failure([
        Check("unsupported_topic", of.isNotNull()), Check("payload_not_object", F.col(value).rlike(r"^\s*\{") & F.get_json_object(value, "$").isNotNull()), Check("unsupported_stage", field("stage") == "7K.5"),
        Check("missing_model_key", required("model_key").isNotNull()), Check("topic_model_mismatch", required("model_key") == of), Check("missing_prediction_event_id", required("prediction_event_id").isNotNull()),
        Check("missing_model_version", required("model_version").isNotNull()), Check("missing_entity", entity.isNotNull()),
    ])
    return messages.withColumns({
        "prediction_event_id": required("prediction_event_id"), "model_key": required("model_key"), "model_version": required("model_version"), "decision_type": kind, "entity_key": entity,
        "branch_id": field("branch_id"), "product_id": field("product_id"), "batch_id": field("batch_id"), "action_required": action, "severity": severity, "recommended_units": units,
        "probability": number("probability"), "threshold": number("operating_threshold"), "acceptance_smoke": flag("acceptance_smoke"), "decision_error": error,
    })
